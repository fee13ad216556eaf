import pytest

from evispark.llm import mojibake

TEXT = "Nämnden för stöd i hemmet föreslår att vårdbiträden i Snödeåker får språkträning – från maj.\nÖversikt över Ängsön och Åsele."


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1", "iso8859_15", "mac_roman", "cp437", "cp850", "cp1251"])
def test_multibyte_round_trip(wrong):
    damaged = "".join(bytes([b]).decode(wrong, "replace") if b >= 0x80 else chr(b) for b in TEXT.encode())
    if "�" in damaged:  # bytes that the encoding leaves open become controls
        damaged = "".join((bytes([b]).decode(wrong) if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b)) if b >= 0x80 else chr(b) for b in TEXT.encode())
    fixed, spans, how = mojibake.repair(damaged)
    assert fixed == TEXT and spans and how.startswith("utf-8<")


def test_twice_damaged():
    once = "för äldre".encode().decode("latin_1")
    assert mojibake.repair(once.encode().decode("cp1252"))[0] == "för äldre"


@pytest.mark.parametrize("actual,wrong", [("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "latin_1"), ("cp1252", "cp850"), ("mac_roman", "latin_1")])
def test_single_byte(actual, wrong):
    text = "Jämfört med 2019 har andelen planerare på nivå B2 stigit"
    fixed, _, how = mojibake.repair(text.encode(actual).decode(wrong))
    assert fixed == text and how == f"{actual}<{wrong}" or wrong == "latin_1" and fixed == text


@pytest.mark.parametrize("text", [None, "", TEXT, "Čelákova", "Šumava™", "«Õnnela»", "± 2 ‰", "3 × 40 ÷ 2", "Âge Œuvre", "Ãlvora", "Ñandú–Ibérica", "Łąkowa", "Größe", "Þórsvikur", "Дубрава", "Σύνθεμα", "à la carte ¼", "Hamre–Åsele", "🍲 två", "för\u00ad\u0435n", "”Ängen”, sade hon"])
def test_right_text_stays(text):
    assert mojibake.repair(text) == (text, [], None)


def test_lost_characters_are_reported():
    assert mojibake.repair("S� g�r det")[2] == "lost"
    assert mojibake.damaged("a\x85b")


def test_tables(spark):
    df = spark.createDataFrame([(1, "fÃ¶r", "x"), (1, "fÃ¶r", "x"), (2, None, "x"), (None, "pÃ¥", "x"), (3, "", "x"), (4, "å" * 300_000 + "Ã¶", "x"), (5, "för", "x")], "n bigint, t string, text string")
    got = mojibake.repair_text(df, "n", "t", "k").collect()
    assert sorted((str(r["record_id"]), r["restored"][-3:]) for r in got) == [("1", "för"), ("1", "för"), ("4", "ååö"), ("None", "på")]
    assert mojibake.repair_text(df.limit(0), "n", "t", "k").collect() == []


@pytest.mark.parametrize("text", ["…och därför beslutade nämnden.", "–jag vet inte …", "„zitat“ ord", "…"])
def test_windows_may_begin_with_dots_and_dashes(text):
    assert mojibake.repair(text) == (text, [], None) and not mojibake.damaged(text)


def test_the_rest_of_a_cut_letter_is_lost():
    assert mojibake.repair("\xa4nstemän i Dal")[2] == "lost"


@pytest.mark.parametrize("times", [1, 2, 3, 4, 5])
def test_damaged_any_number_of_times(times):
    text = "för äldre i Ängsön"
    damaged = text
    for _ in range(times):
        damaged = damaged.encode().decode("latin_1")
    fixed, spans, how = mojibake.repair("ren text, " + damaged + " slut")
    assert fixed == "ren text, " + text + " slut" and how.count("utf-8<") == times
    assert all(damaged[a - 10 : b - 10].isascii() is False for a, b in spans)
    outside = "ren text, " + damaged + " slut"
    for a, b in reversed(spans):
        outside = outside[:a] + outside[b:]
    assert outside.isascii()


def test_places_of_all_steps_are_told():
    text = "fÃ¶r " + "Ã…se".encode().decode("cp1252") + " slut \ufffd"
    fixed, spans, how = mojibake.repair(text)
    assert fixed.startswith("för Åse") and how.endswith("lost") and len(spans) == 3 and spans[-1] == (len(text) - 1, len(text))


def test_held_out_texts_come_back():
    import random

    rng = random.Random(11)
    words = "nämnden för stöd i hemmet föreslår att vårdbiträden får språkträning kökets lördagar ål öppet ärende åtgärd Örebro Åsele Ängelholm båda något själv också kostnaden träffar".split()
    pairs = [("utf-8", w) for w in ("cp1252", "latin_1", "mac_roman", "cp437", "cp850")] + [("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437")]
    right = total = false = 0
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(25)).capitalize() + "."
        false += mojibake.damaged(text)
        for actual, read in pairs:
            raw = text.encode(actual)
            damaged = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in raw)
            total += 1
            right += mojibake.repair(damaged)[0] == text
            assert mojibake.damaged(damaged)
    assert not false and right >= 0.97 * total, (right, total)


def test_finding_is_repairing(spark):
    rows = [(k, t) for k, t in enumerate(["fÃ¶r", None, "", "för", "S� g�r", "…och", "a\x85b", "J‰mfˆrt med"])]
    df = spark.createDataFrame(rows, "n int, text string")
    assert {r["record_id"] for r in mojibake.find_damaged(df, "n", "text", "x").collect()} == {r["record_id"] for r in mojibake.repair_text(df, "n", "text", "x").collect()} == {"0", "4", "6", "7"}
