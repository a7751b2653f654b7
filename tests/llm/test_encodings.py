import pytest

from tidesift.llm.encodings import Model, garbled_documents, restore_text

WORDS = {"größe": 40, "die": 90, "versión": 40, "corrigió": 40, "это": 30, "файлов": 60, "ошибок": 60, "проверено": 60, "później": 40, "źle": 40, "it’s": 80, "the": 400, "mask": 200, "fixed": 90, "naïma": 3, "новый": 50}
CHARACTERS = {c: 60 for c in "äößüéèóíñÄÖÜабвгдежзийклмнопрстуфхцчшщъыьэюяФОП’“”–—źąęśłóïこのノードマスク処理は非常に遅いです。"} | {"Ã": 12, "©": 4, "Ð": 3, "î": 20, "â": 10, "€": 9, "™": 5, "¼": 4, "�": 2} | dict.fromkeys("ƒ¶ÅŸ¸Â", 3)
MODEL = Model(WORDS, CHARACTERS, 1000)
TEXTS = ["Die Größe", "La versión corrigió", "Проверено файлов, ошибок", "Później źle", "It’s “fixed” – the mask", "このノードのマスク処理は非常に遅いです。"]
CHANNELS = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp866")]
PAIRS = [("Проверено файлов, ошибок", "koi8-r", "cp1251"), ("Проверено файлов, ошибок", "cp1251", "cp866"), ("Проверено файлов, ошибок", "cp1251", "latin-1"), ("Później", "iso8859-2", "cp1250")]


@pytest.mark.parametrize("right, wrong", CHANNELS)
@pytest.mark.parametrize("text", TEXTS[:5])
def test_round_trip(text, right, wrong):
    garbled = text.encode(right).decode(wrong)
    assert restore_text(MODEL, garbled)[0] == text


def test_windows_reading_twice():
    once = "It’s “fixed”".encode().decode("cp1252", "replace").replace("�", "\x9d")
    assert restore_text(MODEL, once)[0] == "It’s “fixed”"
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert restore_text(MODEL, twice)[0] == "Größe"


@pytest.mark.parametrize("text, right, wrong", PAIRS)
def test_single_bytes(text, right, wrong):
    assert restore_text(MODEL, text.encode(right).decode(wrong))[0] == text


@pytest.mark.parametrize("text", ["Это проверено и новый, а не ошибок", "Проверено: новый щит"])
@pytest.mark.parametrize("right, wrong", [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("utf-8", "cp1252")])
def test_neighbours(text, right, wrong):
    """Short and unknown words of a stretch are read as those around them; correct ones beside it stay."""
    garbled = text.encode(right).decode(wrong, "replace").replace("\ufffd", "\x81")
    before = "die Größe " + "plain text of the corpus and more of it " * 3
    assert restore_text(MODEL, before + garbled)[0] == before + text
    assert restore_text(MODEL, text) == (text, 0)


@pytest.mark.parametrize("wrong", ["cp932", "gb18030", "euc_jp", "big5", "euc_kr"])
def test_multibyte_readings_of_utf8(wrong):
    text = "größe"
    raw = text.encode()
    garbled = raw.decode(wrong, "replace")
    assert restore_text(MODEL, f"die {garbled} the")[1] == 1


def test_shift_sequences():
    japanese = "ノードの処理"
    assert restore_text(MODEL, f"a {japanese.encode('iso2022_jp').decode('ascii')} b") == (f"a {japanese} b", 1)
    assert restore_text(MODEL, "die gr+APYA3w-e")[0] == "die größe"
    for plain in ("+49-1234-5678", "C++11-based", "a+b-c", "\x1b[31mred\x1b[0m", "x+AAAA-", "1+ABCD-2"):
        assert restore_text(MODEL, plain) == (plain, 0)


def test_words_that_one_source_alone_has(spark):
    """A source that is garbled throughout doesn't vouch for its garbled words, however many texts it has."""
    words = "плагин загружает файл очень медленно когда маска большая".split()
    text = lambda i: " ".join(words[i % 3 :] + words[: i % 3] + [f"n{i}"])
    good = [(i, text(i), f"s{i % 4}") for i in range(200)]
    bad = [(1000 + i, text(i).encode("cp1251").decode("cp1252"), "hot") for i in range(150)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string, source string")
    got = {r.doc_id: r.restored for r in garbled_documents(docs).collect()}
    assert got == {1000 + i: text(i) for i in range(150)}


def test_east_asian_and_lost_bytes():
    text = TEXTS[5]
    assert restore_text(MODEL, "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode("cp932")))[0] == text
    assert restore_text(MODEL, "La versi�n corrigi�")[0] == "La versión corrigió"
    assert restore_text(MODEL, "x � y") == ("x � y", 1)


@pytest.mark.parametrize("text", [*TEXTS, "ÀÁÂÃÄÅ ÆÇÈÉ ÐÑÒÓ", "AÇÃO, VISÃO", "see\xa0the\xa0mask", "&eacute; \\u00e9 %C3%A9", "5 € ™", "Ελληνικά 🙂", "«СССР»", "", "ascii"])
def test_correct_text_stays(text):
    assert restore_text(MODEL, text) == (text, 0)


def test_operator(spark):
    good = [f"Die Größe ist {i}. It’s “fixed”." for i in range(30)]
    bad = "Die Größe: It’s".encode().decode("cp1252")
    rows = [(i, t) for i, t in enumerate([*good, good[0], bad, bad, None, "", "plain", "x" * 100_000 + " é"])]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id bigint, text string, restored string, _text string")
    got = {r.doc_id: r.restored for r in garbled_documents(docs).collect()}
    assert got == {31: "Die Größe: It’s", 32: "Die Größe: It’s"}
    assert garbled_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [50, 900, 1100, 100_000])
@pytest.mark.parametrize("right", ["αλφα", "😀", "한국", "سلام", "→"])
def test_characters_that_the_corpus_lacks(texts, right):
    """Whether plainly valid UTF-8 is read doesn't depend on the size of the corpus, or on its characters."""
    wrong = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in right.encode())
    model = Model({"the": texts // 2}, dict.fromkeys(set(wrong), 1), texts)
    assert restore_text(model, f"the {wrong} the") == (f"the {right} the", 1)
    assert restore_text(model, f"the {right} the")[1] == 0


@pytest.mark.parametrize("texts", [50, 100_000])
def test_chance_sequences(texts):
    model = Model({"the": texts // 2}, {"É": max(2, texts // 50), "»": max(2, texts // 50), "«": max(2, texts // 50)}, texts)
    assert restore_text(model, "the «CAFÉ» the")[1] == 0
