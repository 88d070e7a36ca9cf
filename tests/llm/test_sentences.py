import pytest

from pairlight.llm.sentences import occurrences, sentence_units, units


def cut(text):
    return [text[a:b] for a, b in units(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("He met Dr. Smith (see fig. 3). It cost 3.5 million.", ["He met Dr. Smith (see fig. 3).", "It cost 3.5 million."]),
        ("E. N. Miller came. He left at 5 p.m. sharp… Really?! Yes.", ["E. N. Miller came.", "He left at 5 p.m. sharp…", "Really?!", "Yes."]),
        ("“Does it?” asked Ann. “No. Never.” She left.", ["“Does it?” asked Ann.", "“No. Never.”", "She left."]),
        ("The judge wrote: \"No harm. None.\" Next one.", ["The judge wrote: \"No harm. None.\"", "Next one."]),
        ("It was kept apart.They left.What now?Go.", ["It was kept apart.", "They left.", "What now?", "Go."]),
        ("Write to a.b@c.example or www.Example.com/x.html today. Done.", ["Write to a.b@c.example or www.Example.com/x.html today.", "Done."]),
        ("Version v2.12.1 ran on 12.05.1980. Fine.", ["Version v2.12.1 ran on 12.05.1980.", "Fine."]),
        ("The panel waited … and then went on. So.", ["The panel waited … and then went on.", "So."]),
        ("Thanks, Ann! :-) No. 5 is next. Wow! 😀 Good.", ["Thanks, Ann! :-)", "No. 5 is next.", "Wow! 😀", "Good."]),
        ("Lists, files etc. A new one. It was side B. The end; really: yes.", ["Lists, files etc.", "A new one.", "It was side B.", "The end; really: yes."]),
        ("Summary\n\nIt was given a\nuniform.\r\nNext line.\nConclusion: YES", ["Summary", "It was given a\nuniform.", "Next line.", "Conclusion: YES"]),
        ("Findings, May 2018\nThe rate rose.", ["Findings, May 2018", "The rate rose."]),
        ("Items:\n- one thing, here\n- two. Then more\n1. Scope\nText.", ["Items:", "- one thing, here", "- two.", "Then more", "1. Scope", "Text."]),
        ("Dr. Moki prüfte ca. 3 Fälle, z. B. zwei. Am 3. Januar 2002 war es d. h. da. Er ging.", ["Dr. Moki prüfte ca. 3 Fälle, z. B. zwei.", "Am 3. Januar 2002 war es d. h. da.", "Er ging."]),
        ("„Nein“, sagte Prof. Haneje. „Fragen Sie. Bitte.“ Die Halle.", ["„Nein“, sagte Prof. Haneje.", "„Fragen Sie. Bitte.“", "Die Halle."]),
        ("« Non, dit-elle. Revenez ! » M. Sabo a relu env. 3 cas, p. ex. un. Qui ?", ["« Non, dit-elle. Revenez ! »", "M. Sabo a relu env. 3 cas, p. ex. un.", "Qui ?"]),
        ("«No —dijo—. Vuelva.» ¡Qué raro! El Sr. Gil firmó el acta n.º 6.", ["«No —dijo—. Vuelva.»", "¡Qué raro!", "El Sr. Gil firmó el acta n.º 6."]),
        ("В 2021 г. ферма, т. е. дом. А. П. Тарвин ушёл. «Да? Нет», — сказал он.", ["В 2021 г. ферма, т. е. дом.", "А. П. Тарвин ушёл.", "«Да? Нет», — сказал он."]),
        ("苏禾说：“不行。明天再来。”“可以吗？”白石问道。他想了很久……最后拒绝了。真的吗？！", ["苏禾说：“不行。明天再来。”", "“可以吗？”白石问道。", "他想了很久……最后拒绝了。", "真的吗？！"]),
        ("「いいえ。明日。」と彼は答えた。差は……まだ分からない。", ["「いいえ。明日。」と彼は答えた。", "差は……まだ分からない。"]),
        ("สวัสดีครับ ผมชื่อ John มาจาก 2 ประเทศ ไทย\nดี", ["สวัสดีครับ", "ผมชื่อ John มาจาก 2 ประเทศ", "ไทย", "ดี"]),
        ("سأل د. سمير: «هل يهم؟» هذا مسموح. من يقرر؟", ["سأل د. سمير: «هل يهم؟»", "هذا مسموح.", "من يقرر؟"]),
        ("डॉ. राम ने पूछा, “क्या यह ठीक है?” यह सही है।", ["डॉ. राम ने पूछा, “क्या यह ठीक है?”", "यह सही है।"]),
        ("  \n\xa0 ", []), ("", []), (None, []), ("no end", ["no end"]), ("...", ["..."]),
    ],
)
def test_units(text, want):
    assert (cut(text) if text else units(text)) == want


def test_the_document_teaches_its_abbreviations():
    plain = "We saw the zq. Then we left."
    taught = "The zq. is new and the zq. is old. We saw the zq. building. " + plain
    assert cut(plain) == ["We saw the zq.", "Then we left."]
    assert "The zq. is new and the zq. is old." in cut(taught)
    assert occurrences(taught)["zq", 2] == 3


def test_positions_cover_the_text():
    text = " A  b. C d!  \n\n “E.” f? 😀 G\r\n- h\n"
    found = units(text)
    assert all(text[a:b] == text[a:b].strip() and a < b for a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    left = "".join(text[x:y] for x, y in zip([0, *[b for _, b in found]], [*[a for a, _ in found], len(text)]))
    assert not left.strip()


def test_documents(spark):
    rows = [(1, "A b. C d.", "x"), (2, None, "x"), (3, " ", "x"), (4, "word " * 30_000 + ".", None), (1, "E.", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sent_start string")
    got = sorted(tuple(r) for r in sentence_units(df).collect())
    assert got == [(1, 0, 2), (1, 0, 4), (1, 5, 9), (4, 0, 150_001)]
    assert sentence_units(df.limit(0)).count() == 0


def test_the_document_comes_before_the_lists():
    assert cut("Everybody likes Max and Max likes them. Yesterday we met Max. He was tired.") == ["Everybody likes Max and Max likes them.", "Yesterday we met Max.", "He was tired."]
    assert cut("A fig tree grows here. She ate a fig. Then she left.") == ["A fig tree grows here.", "She ate a fig.", "Then she left."]
    assert cut("See fig. 3 and max. five. The rest is in fig. Two.") == ["See fig. 3 and max. five.", "The rest is in fig. Two."]
    assert cut("Dr Lee called Dr. Smith. He came.") == ["Dr Lee called Dr. Smith.", "He came."]


def test_the_corpus_decides_where_the_document_says_nothing():
    text = "He told it to me. Then he left. We saw the zq. building."
    assert [text[a:b] for a, b in units(text, {"me": (900, 1, 0, 900, 0, 50)})] == ["He told it to me.", "Then he left.", "We saw the zq. building."]
    assert [text[a:b] for a, b in units(text, {"zq": (0, 0, 9, 0, 0, 1)})][-1] == "We saw the zq. building."


def test_no_length_bounds_words_or_the_way_back():
    long = "Donaudampfschifffahrtsgesellschaftskapitänsmützenverordnung" * 3
    taught = f"Die {long}. ist neu, die {long}. ist alt, und sie kennt {long}. genau."
    assert cut(taught) == [taught]
    assert occurrences(taught)[long.lower(), 2] == 3
    assert cut(f"{' ' * 60}small beginnings here. small again there. Large now.")[0] == "small beginnings here."


def test_a_large_corpus_table_is_joined_with_the_same_result(spark):
    rows = [(i, f"We saw the zq. building {i}. It was Dr. Lee who told me. Then he left, usw. Ein Tag.\n\nsmall start here. The zq. is old; the zq. is new. Max came.", "x") for i in range(30)] + [(40, None, "x"), (41, "He told it to me. Then he saw the zq. Building and the rest. Max is Max. So.", "x"), (1, "me. Max. And a zq. Or so. me and me", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, known string")
    assert sorted(map(tuple, sentence_units(df, 0).collect())) == sorted(map(tuple, sentence_units(df).collect()))
