import random

import pytest

from delvework.llm import languages as L
from delvework.llm import lexer, nl_in_code, passages
from hypothesis import given, settings
from hypothesis import strategies as st

PIECES = ['"', "'", '"""', "/*", "*/", "//", "#", "\n", "\\", "a b", "`", "[[", "]]", "--", "<!--", "-->", "<<MSG\n", "\nMSG\n", 'r#"', '"#', "x = 1;", "\n=begin\n", "\n=end\n"]


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(sorted(lexer._RULES)), st.lists(st.sampled_from(PIECES), max_size=30), st.randoms(use_true_random=False))
def test_spans_are_ordered_and_transition_agrees_with_lexing(fam, parts, rnd):
    text = "".join(parts)
    fn, runs = lexer.transition(text, fam)
    for s in lexer.states_of(fam):
        spans, end, _ = lexer.lex(text, fam, s)
        assert (fn[s], runs[s]) == (end, spans)
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:])) and all(0 <= a <= b <= len(text) for _, a, b, *_ in spans)


def whole(text, path, model):
    """Sizes of the languages of a text lexed at once."""
    fam = lexer.family(path)
    spans, _, _ = lexer.lex(text, fam)
    return passages.finished(nl_in_code.summed(spans, text, model, {}), lambda r: nl_in_code.verdict(*r.sums[:2], r.sums[3], model))


SAMPLE = {
    "a.py": ['def f():\n    """Liest alle Zeilen der Datei und zählt die leeren davon.', "    Und noch eine Zeile mehr.", '    """', "    x = 'select a from b where c'", "# El gato duerme en la cama de mi tía.", "y = 2"],
    "b.rs": ["/* The cat sleeps on the", "   bed of my aunt today */", "let a = \"Кот спит на кровати моей тёти\";", "let b: &'static str = \"x\";", "// ok"],
    "c.sh": ["cat <<MSG", "Le chat dort sur le lit de ma tante", "MSG", 'echo "plain/path/to"', "# 猫在我阿姨的床上睡觉了"],
    "d.lua": ["--[[ O gato dorme na cama da minha tia", "]]", "local x = [[猫は私の叔母のベッドで眠っています]]"],
}


def chunk_rows(seed):
    rnd, rows = random.Random(seed), []
    for path, ls in SAMPLE.items():
        ls, at = ls * 3, 0
        while at < len(ls):
            n = rnd.randrange(1, 5)
            rows.append((path, at + 1, "\n".join(ls[at : at + n])))
            if rnd.random() < 0.3:
                rows.append(rows[-1])
            at += n - (rnd.random() < 0.3 and n > 1)
    return rows


def test_blocks_of_any_size_agree(spark):
    model = L.train()
    rows = chunk_rows(1)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "file_path string, start_line int, content string, block string, fn int")
    want = {(p, lang) for p, ls in SAMPLE.items() for lang in whole("\n".join(ls * 3) + "\n", p, model)}
    assert want >= {("a.py", "de"), ("a.py", "es"), ("b.rs", "en"), ("b.rs", "ru"), ("c.sh", "fr"), ("c.sh", "zh"), ("d.lua", "pt"), ("d.lua", "ja")}
    for lines in (1000, 7, 3, 2):
        got = {(r.file_path, r.lang) for r in nl_in_code.files_by_language(df, block_lines=lines).collect()}
        assert got == want, lines


LONG_TEXT = {
    "long.py": ["x = 1", '"""The cat sleeps on the bed.', *["   of the aunt", "   today"] * 40, "Le chat dort sur le lit de ma tante.", *["et encore"] * 30, '"""', "# eine", "# Katze", "# schläft auf", "# dem Bett", "y = 'z'", "# ok", "# so", ""] * 2,
    "gap.rs": ["// der Hund", "// läuft durch", "// den Garten", "", "// the dog runs through", "fn f() {}", "/*", *["", " * the old", " * boat"] * 30, "", "*/"],
    "tags.java": ["/**", " * Reads the rows of the table", " * @param x the", " * number of rows", " * @return", *[" * and some more words"] * 20, " */", "int a; // no"] * 3,
    "here.sh": ["cat <<MSG", *["the old boat leaves the harbour", "le vieux bateau part avec nous", ""] * 25, "MSG", "echo 'done'"],
}


@pytest.mark.parametrize("seed", range(3))
def test_passages_over_any_number_of_blocks(spark, seed):
    rnd, model, rows = random.Random(seed), L.train(), []
    for path, ls in LONG_TEXT.items():
        at = 0
        while at < len(ls):
            n = rnd.randrange(1, 12)
            rows.append((path, at + 1, "\n".join(ls[at : at + n])))
            at += n
    df = spark.createDataFrame(rows, "file_path string, start_line int, content string")
    want = {(p, lang, n) for p, ls in LONG_TEXT.items() for lang, n in whole("\n".join(ls) + "\n", p, model).items()}
    assert {(p, lang) for p, lang, _ in want} >= {("long.py", "en"), ("long.py", "fr"), ("long.py", "de"), ("gap.rs", "de"), ("tags.java", "en"), ("here.sh", "en"), ("here.sh", "fr")}
    for lines, fold in ((1, 3), (2, 4096), (5, 2), (16, 1), (256, 4096)):
        got = nl_in_code.languages_in_code(df, block_lines=lines, fold=fold).collect()
        assert {(r.file_path, r.lang, r.chars) for r in got} == want, (lines, fold)


def test_shares_of_the_table_are_those_of_whole_files(spark):
    chunks = spark.read.parquet("/root/testdata/sf0.001/chunks.parquet")
    rows = lambda **o: sorted(map(tuple, nl_in_code.languages_in_code(chunks, **o).collect()))
    want = rows(block_lines=10**6)
    assert len(want) > 50 and all(rows(block_lines=n, fold=k) == want for n, k in ((2, 3), (16, 4), (256, 4096)))


def test_sums_compose_in_any_grouping():
    rnd, model = random.Random(5), L.train()
    text = "\n".join(x for ls in LONG_TEXT.values() for x in ls) + "\n"
    pieces = [p + "\n" for p in text.split("\n")[:-1]]
    one = [nl_in_code.by_state(p, "python", False, model) for p in pieces]

    def grouped(xs):
        if len(xs) == 1:
            return xs[0]
        k = rnd.randrange(1, len(xs))
        return nl_in_code.composed(grouped(xs[:k]), grouped(xs[k:]), True, model)

    sizes = [passages.finished(grouped(one)[0][1], lambda r: nl_in_code.verdict(*r.sums[:2], r.sums[3], model)) for _ in range(5)]
    assert all(x == sizes[0] for x in sizes) and sizes[0] == whole(text, "a.py", model)


def test_shares_and_dirt(spark):
    df = spark.createDataFrame(
        [(None, 1, "# The cat sleeps on the bed"), ("x.py", None, "# The cat sleeps on the bed today\n"), ("y.py", 1, None), ("z.unknown", 1, "# The cat sleeps on the bed"), ("e.py", 1, "")],
        "file_path string, start_line int, content string",
    )
    got = nl_in_code.languages_in_code(df).collect()
    assert [(r.file_path, r.lang) for r in got] == [("x.py", "en")] and 0.5 < got[0].share < 1
    assert nl_in_code.languages_in_code(df.where("false")).count() == 0
    long = spark.createDataFrame([("l.py", 1, "# " + "The cat sleeps on the bed. " * 20000)], "file_path string, start_line int, content string")
    assert [(r.file_path, r.lang) for r in nl_in_code.files_by_language(long).collect()] == [("l.py", "en")]


def test_code_and_identifiers_are_no_language():
    model = L.train()
    for text in ("found = pop_header(rows, 82)\nif (a) { return b(c); }", "SELECT id, path FROM chunks WHERE module = ?", "idx/v3/part", "@param state input\n@return new value\n@param a input", "noqa: C901"):
        assert not [1 for n, w, _, s in nl_in_code.runs_of(text, model) if nl_in_code.verdict(n, w, s, model)], text


def test_held_out_accuracy():
    xs, ys = L.seed_rows()
    keep = [i for i in range(len(xs)) if i % 5]
    model = L.fit([xs[i] for i in keep], [ys[i] for i in keep])
    test = [i for i in range(len(xs)) if i % 5 == 0 and ys[i] != "none" and len(xs[i]) > 20]
    right = sum(model.label(model.score(L.words_of(xs[i]))) == ys[i] for i in test)
    assert right >= 0.9 * len(test)
