import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.plans import listing_queries
from tablewright.sources.charsets import Detector, detect_charset, page_text

WORDS = {
    "ru": "и в не на я быть он с что это она этот который весь год свой человек сказать только ещё бы себя как уже до время если сам другой вот говорить наш знать стать при чтобы дело жизнь первый очень день новый рука даже раз где там под можно какой после работа слово место цена корзина товар",
    "el": "και το να του η της με που την από για είναι τον σε ο οι στο θα τα στην δεν τη των μου τους αυτό όπως μια ήταν αλλά έχει πως κάτι πολύ ένα μας όταν σας μόνο χρόνια τώρα πριν κόσμος ζωή άνθρωπος ημέρα σπίτι δουλειά τιμή προϊόν καλάθι",
    "pl": "i w nie na się że z jest to do jak ale co tak za być może już tylko będzie są po jego który ich również można także został między więc właśnie cały świat życie człowiek książka źródło łódź gęś wąż żółty śnieg cena sklep zamówienie",
    "cs": "a se v na je že o s z do i to k ve pro za by ale si po jsem tak jako být který jeho než může při už však ještě člověk život svět město voda kůň říci věc dům země žena děti otázka příklad třeba řeka cena košík",
    "fr": "le la les des été être où déjà après très même fenêtre français élève garçon âge île tête noël forêt panier prix à vérité où château",
    "de": "der die das über für möglich schön größe straße hören grün müssen könnte während äpfel öffnen preis übung warenkorb natürlich heißt",
    "es": "el la los niño año español también más está qué según canción corazón jamás así día mañana precio cesta razón número árbol último",
    "zh": "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从产品价格购物车添加图片商品名称型号",
    "zht": "的一是不了人我在有他這為之大來以個中上們到說國和地也子時道出而要於就下得可你年生自會那後能對著事其裡所去行過家十用發天如然作方成者多日都三小軍二無同麼經法當起與好看學進種將還分此心前面又定見只主沒公從產品價格購物車添加圖片商品名稱型號",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって 日本 商品 価格 時間 会社 世界 カート データ テレビ ニュース ページ",
    "ko": "이 그 저 것 수 등 및 에서 그리고 하다 있다 되다 없다 나 사람 우리 아니다 보다 같다 주다 대하다 가다 년 한 말 일 때 문제 위하다 오다 알다 크다 사회 많다 안 좋다 그러나 받다 집 나오다 상품 가격 장바구니 구매 한국 시간",
}
CASES = [
    ("utf-8", "utf-8", "fr"), ("utf-8", "utf-8", "zh"), ("windows-1252", "cp1252", "fr"), ("windows-1252", "cp1252", "de"), ("windows-1252", "cp1252", "es"), ("windows-1251", "cp1251", "ru"),
    ("koi8-r", "koi8_r", "ru"), ("iso-8859-5", "iso8859_5", "ru"), ("windows-1253", "cp1253", "el"), ("windows-1250", "cp1250", "pl"), ("windows-1250", "cp1250", "cs"), ("gb18030", "gb18030", "zh"),
    ("big5", "big5", "zht"), ("shift_jis", "cp932", "ja"), ("euc-jp", "euc_jp", "ja"), ("euc-kr", "cp949", "ko"),
]
CODEC = {"ascii": "utf-8", "shift_jis": "cp932", "euc-kr": "cp949", "windows-1252": "cp1252"}


def text(rng, language, sentences):
    words, out = WORDS[language], []
    for _ in range(sentences):
        if language in ("zh", "zht"):
            out.append("".join(rng.choice(list(words), rng.integers(5, 20))) + "，")
        else:
            some = list(rng.choice(words.split(), rng.integers(4, 12)))
            out.append(("" if language == "ja" else " ").join([some[0].capitalize(), *some[1:]]) + ("。" if language == "ja" else ". "))
    return "<html><p class=x>" + "".join(out) + "</p></html>"


@pytest.mark.parametrize("sentences,least", [(1, 0.72), (4, 0.97), (12, 0.995)])
def test_charsets_of_two_hundred_texts_each(sentences, least):
    detect, rng = Detector(), np.random.default_rng(3)
    for _, codec, language in CASES:
        right = 0
        for _ in range(200):
            body = text(rng, language, sentences).encode(codec, "ignore")
            found = detect(body)[0]
            # What counts is that the text comes back; two charsets may agree on it.
            right += body.decode(CODEC.get(found, found), "replace") == body.decode(codec)
        assert right >= 200 * least, (codec, language, right)


def test_odd_bytes():
    detect = Detector()
    assert detect(None) == detect(b"") == detect(b"<p>plain") == ("ascii", 1.0)
    assert detect("é".encode("utf-8"))[0] == "utf-8"
    assert detect(b"\xef\xbb\xbfx")[0] == "utf-8"
    assert detect("Größe".encode("utf-16"))[0] == "utf-16le"
    assert detect("plain text".encode("utf-16-be"))[0] == "utf-16be"
    assert detect(bytes(range(128, 256)) * 3)[0] in {"windows-1252", "windows-1250", "windows-1251", "koi8-r", "iso-8859-5", "windows-1253"}
    # A long body takes time in proportion to its length.
    assert detect(("ça va très bien. " * 60_000).encode("cp1252"))[0] == "windows-1252"
    assert detect(b"\xff" * 2_000_000)[0]


#: Latin-1 texts whose few words beyond ASCII are likelier letters of another script if they are read alone, or read once for each time that they are repeated.
LATIN = [
    "Aionon on èê, le paeuxel", "Eniebe öö, getzte.", "enstungge" + " üß" * 29, "Ehe die Ê kam, war es gut.", "Aireou un vi çç anou etenaieauvi reou pour èè de.",
    "EIN SCHÜ!! " + "EINÄÄ!! ÖÄ!! " * 56 + "UND DIE KLASSE", "Ehe Ñíco kam, war es gut.", "Die ÈÈ kam, als es schon sehr lange gut war.",
]


def test_latin_words_speak_against_other_scripts():
    detect = Detector()
    assert [detect(t.encode("cp1252"))[0] for t in LATIN] == ["windows-1252"] * len(LATIN)
    # Markup is no text, and a few brand names are outweighed.
    page = "<html><head><script>var some = code, that = of(other, words); // and more of them, as scripts go</script></head><body class=wide><p>{}</p></body></html>"
    for words, codec, name in (("он и она", "cp1251", "windows-1251"), ("новый Apple iPhone Pro Max купить", "cp1251", "windows-1251"), ("商品价格", "gb18030", "gb18030"), ("ASUS ROG Strix Gaming 产品图片", "gb18030", "gb18030"), ("가격 USB HDMI 상품", "cp949", "euc-kr")):
        assert detect(page.format(words).encode(codec))[0] == name, words


def test_detected_charsets_of_odd_documents_equal_sql(spark, tmp_path):
    texts = [*LATIN, "", None, "a", "é", "\n", "Größe der Straße", "日本 shop online ключ 𝄞 clef für alle", "\ufeffabc", "aéb", "a\u00a0b"]
    # Without a byte order mark, UTF-16 is known by the zeros of Latin letters.
    rows = [(4 * i + k, t) for i, t in enumerate(texts) for k in range(4) if k != 2 or max(t or "a") < "\u0100"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = listing_queries.QUERIES["s05_detected_charset"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(listing_queries.SQL["s05_detected_charset"]).fetchall())


def test_columns(spark):
    texts = ["Größe", "Цена товара и корзина, очень новый год", "商品价格，购物车。这是我们的产品", "", None]
    rows = list(zip(texts, ["cp1252", "koi8_r", "gb18030", "ascii", None], strict=True))
    df = spark.createDataFrame([(t, t.encode(c) if t is not None else None) for t, c in rows], "t string, b binary")
    got = df.select("t", detect_charset(F.col("b"))["charset"].alias("c"), page_text(F.col("b")).alias("back")).collect()
    assert [r.back for r in got] == [*texts[:4], ""]
    assert [r.c for r in got] == ["windows-1252", "koi8-r", "gb18030", "ascii", "ascii"]
