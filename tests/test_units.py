"""Edge rows of functions, operators, sources and sinks."""

import json
import random
import tracemalloc
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import corpus, evaluation, generation, prefs, reports, submission
from corpusmill.sources import parallel, records, xlsx
from corpusmill.streaming import resume


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [x["o"] for x in df.select("i", f(F.col("s")).alias("o")).orderBy("i").collect()]


def test_strip_tokens(spark):
    given = ["", None, "  ", "--", "Don't,", "café", "a b\x1cc", "The the THE"]
    assert column(spark, given, T.strip_tokens) == [[], [], [], [], ["don't"], ["caf"], ["a", "b", "c"], ["the", "the", "the"]]
    assert column(spark, given[-1:], T.unique_tokens) == [["the"]]


def test_text_functions(spark):
    assert column(spark, [" a  b\n\tc "], T.sanitize) == ["a b c"]
    assert column(spark, ["A1", "Z9", "AA10", "ab3"], T.column_index) == [0, 25, 26, 27]
    assert column(spark, ["a-b c_d 'x", "it's 1/2!"], T.qe_tokens) == [["a-b", "c", "d", "'", "x"], ["it's", "1/2", "!"]]
    assert column(spark, ["", "a,b 1,2.3 c\\d।"], T.indic_tokens) == [[""], ["a", ",", "b", "1,2.3", "c\\d", "।"]]
    assert column(spark, ["Hello, world. 1,000-2", "&quot;x&quot; it's"], T.tokens_13a) == [["hello", ",", "world", ".", "1,000", "-", "2"], ['"', "x", '"', "it's"]]
    assert column(spark, ["h\n\nb\n\nc", "x"], T.first_segment_rest) == ["b\n\nc", "x"]
    assert column(spark, ["h\n\nb\n\nc", "x"], T.last_segment) == ["c", "x"]
    assert column(spark, ["English - Karbi Training Data 2026.xlsx", "English-Old  Nagamese  Training Data.xlsx", "karbi.xlsx"], T.language_of_file) == ["Karbi", "Old_Nagamese", "Karbi"]
    assert column(spark, ["```json\n{\"a\": {\"b\": 1}}\n```", "no", "{broken", "{bad}"], T.json_object_in) == ['{"a": {"b": 1}}', None, None, None]


def test_split_partitions_the_input(spark):
    for n in (0, 1, 5, 50):
        got = corpus.split(spark.range(n), F.col("id")).collect()
        assert sorted(x["id"] for x in got) == list(range(n))
        assert sum(x["split"] == "train" for x in got) == round(n * 0.8)


def test_hints(spark):
    cands = spark.createDataFrame([("water", "di", 9000, 1), ("water", "ti", 6150, 2), ("is", "o", 10000, 1)], "word string, target string, p_bp long, rank int")
    pairs = spark.createDataFrame([(1, "Water is, water."), (2, "none")], "pair_id long, english string")
    got = {x["pair_id"]: x for x in corpus.instructions(pairs, cands, "X").collect()}
    assert got[1]["instruction"].endswith("words in this sentence:\n- water: di (0.90) / ti (0.61)\n- is: o (1.00)\n\nWater is, water.")
    assert (got[1]["n_hints"], got[2]["n_hints"]) == (2, 0) and "Helpful" not in got[2]["instruction"]


def loop_fix(text, tokens, cap, n=3):
    seen, out = set(), []
    for i, w in enumerate(tokens):
        if len(out) >= cap:
            return " ".join(out)
        if i >= n - 1:
            gram = tuple(tokens[i - n + 1 : i + 1])
            if gram in seen:
                return " ".join(out)
            seen.add(gram)
        out.append(w)
    return text


def test_decode_fix(spark):
    rng = random.Random(1)
    texts = ["", "a", "a  b", "a b c a b c d", " ".join(map(str, range(70)))] + [" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    for x in evaluation.decode_fix(df, "s").collect():
        tokens = " ".join(x["s"].split()).split(" ")
        assert x["fixed"] == loop_fix(x["s"], tokens, min(64, max(2 * len(tokens), len(tokens) + 8)))
    assert [x["collapsed"] for x in evaluation.collapse_fix(spark.createDataFrame([("a a  b b a",), ("a  b",)], "s string"), "s").collect()] == ["a b a", "a  b"]


def test_collapse_splits_a_text_once(spark):
    text = "न 1,2 . x x y " * 2000
    tokens = text.split()
    kept = [w for i, w in enumerate(tokens) if not i or w != tokens[i - 1]]
    df = evaluation.collapse_fix(spark.createDataFrame([(text,), (None,), ("",), ("x  y",)], "s string"), "s")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.columns == ["s", "collapsed"] and plan.count("split(") == 1
    assert [r["collapsed"] for r in df.collect()] == [" ".join(kept), None, "", "x  y"]


def test_quality_signals(spark):
    df = spark.createDataFrame([("", "x"), ("a a a a", "b"), ("one two", ""), ("abcabc" * 6, "z")], "h string, s string")
    rows = evaluation.quality_signals(df, "h", "s").collect()
    assert (rows[0]["empty"], rows[0]["too_short"], rows[0]["rep3_rate"], rows[0]["quality"]) == (1, 1, 10000, 0)
    assert (rows[1]["dup_rate"], rows[1]["distinct_1"], rows[1]["too_long"]) == (7500, 2500, 1)
    assert (rows[2]["length_ratio"], rows[2]["too_short"]) == (0, 1)
    assert rows[3]["runaway"] == int((1 - 3 / 34) * 36 / 60 * 10000 + 0.5)


def test_scores_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "a b c d e")], "pair_id int, s string").withColumn("w", F.split("s", " "))
    stats = evaluation.clipped_matches(df, [("w", "w", 4)])
    assert evaluation.bleu(stats).first()["bleu_e4"] == 1000000
    for words in (0, 2):
        assert evaluation.chrf(evaluation.chrf_stats(df, "s", "s", words)).first()["chrf_e4"] == 1000000
    assert {r["n"]: r["precision_e4"] for r in evaluation.bleu_parts(stats).collect()} == dict.fromkeys(range(1, 5), 10000)


def test_orders_without_reference_do_not_count(spark):
    df = spark.createDataFrame([(1, "abcd", "abc"), (2, "abcdefgh", "x"), (3, None, "ab"), (4, "ab", None), (5, "", "")], "pair_id int, h string, r string")
    stats = {r["n"]: (r["matches"], r["hyp_total"], r["ref_total"]) for r in evaluation.chrf_stats(df, "h", "r").collect()}
    assert stats == {1: (3, 12, 6), 2: (2, 3, 3), 3: (1, 2, 1)}


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("as_words", [False, True])
def test_counting_takes_no_more_memory_for_larger_batches(as_words):
    rng = random.Random(3)
    side = ["".join(rng.choices("abcdefgh नि", k=1000)) for _ in range(200)]
    for times in (1, 10):
        texts = pa.array(side * times)
        column = pa.array([list(x) for x in side] * times) if as_words else texts
        batch = pa.record_batch({"h": column, "r": column})
        assert peak_mb(lambda: [x.num_rows for x in evaluation._counted(batch, [("h", "r", 6)], (), True, evaluation.STEP)]) < 80


def test_repeats_hold_one_text_of_a_batch(spark):
    tokens = pa.array([[str(i) for i in range(1000)] + ["0", "1", "2"], None, ["a"]] + [[f"{j} {i}" for i in range(100)] for j in range(2000)])
    got = []
    # all words as Python strings would be more than 10 MB
    assert peak_mb(lambda: got.append(evaluation._repeats(3, False).func(tokens))) < 4
    assert got[0].to_pylist() == [1002, *[None] * 2002]


def test_measures_hold_one_pair_of_a_batch(spark):
    lists = pa.array([["a"], []] + [[f"{j} {i}" for i in range(100)] for j in range(2000)])
    for kind, answer in (("long", 200), ("double", 200.0)):
        got = []
        # all words as Python strings would be more than 10 MB
        assert peak_mb(lambda: got.append(evaluation.pair_measure(lambda a, b: len(a) + len(b), kind).func(lists, lists))) < 4
        assert got[0].to_pylist() == [2, 0, *[answer] * 2000] and str(got[0].type) == {"long": "int64"}.get(kind, kind)


def test_counts_do_not_depend_on_steps(spark):
    rng = random.Random(4)
    text = lambda: None if rng.random() < 0.1 else "".join(rng.choice("abन\U0001f600") for _ in range(rng.choice([0, 1, 5, 40])))
    rows = [(rng.choice(["x", "y", None]), text(), text()) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, h string, r string")
    want = {}
    for g, h, r in rows:
        for n in range(1, 4):
            a, b = (Counter((x or "")[i : i + n] for i in range(len(x or "") - n + 1)) for x in (h, r))
            for k in (n, n + 3):
                if k == n or h and r:
                    have = want.setdefault((g, k), [0, 0, 0])
                    for i, x in enumerate(((a & b).total(), a.total() if b else 0, b.total())):
                        have[i] += x
    words = df.withColumns({s + "w": F.when(F.length("h") * F.length("r") > 0, F.split(s, "")) for s in "hr"})
    for step in (1, 50, evaluation.STEP):
        got = evaluation.clipped_matches(words, [("h", "r", 3), ("hw", "rw", 3)], ("g",), True, step).collect()
        assert {(x["g"], x["n"]): [x["matches"], x["hyp_total"], x["ref_total"]] for x in got} == {k: v for k, v in want.items() if sum(v[1:])}


def test_words_and_marks(spark):
    got = column(spark, ["Hi, (all) .", "--", "", None, "a\u00a0b!"], lambda c: T.words_and_marks(c))
    assert got == [["Hi", ",", "(all", ")", "."], ["-", "-"], [], None, ["a", "b", "!"]]


def test_meteor_aligns_from_the_right():
    # the last of the two a's is matched: one chunk
    assert evaluation.meteor("A x a b".split(), "a b".split()) == pytest.approx(0.5 / (0.9 * 0.5 + 0.1) * (1 - 0.5 * (1 / 2) ** 3))


def test_meteor_stems_and_synonyms():
    stem, synonyms = (lambda w: w.rstrip("s")), {"big": {"large", "huge"}}
    score = lambda m, n, chunks: (m / n) * (1 - 0.5 * (chunks / m) ** 3)
    hyp, ref = "big Cats run far".split(), "large cat run away".split()
    assert evaluation.meteor(hyp, ref) == pytest.approx(score(1, 4, 1))
    assert evaluation.meteor(hyp, ref, stem) == pytest.approx(score(2, 4, 1))
    assert evaluation.meteor(hyp, ref, stem, synonyms) == pytest.approx(score(3, 4, 1))
    # synonyms are looked up for words of hyp only
    assert evaluation.meteor(["huge"], ["big"], None, synonyms) == 0
    # an equal word is taken before one of equal stem, and only once
    assert evaluation.meteor(["cats", "cat"], ["cat"], stem) == pytest.approx(0.5 / (0.9 * 0.5 + 0.1) * 0.5)
    assert evaluation.meteor([], [], stem, synonyms) == 0
    # each stage against a plain loop over what is free
    rng = random.Random(5)
    for _ in range(200):
        h, r = ([rng.choice(["a", "as", "b", "bs", "big", "huge", "large"]) for _ in range(rng.randint(1, 7))] for _ in range(2))
        left, free, found = [*range(len(h))], [*range(len(r))], []
        for same in (lambda x, y: x == y, lambda x, y: stem(x) == stem(y), lambda x, y: x == y or y in synonyms.get(x, ())):
            for i in left[::-1]:
                for j in free[::-1]:
                    if same(h[i], r[j]):
                        found.append((i, j)), left.remove(i), free.remove(j)
                        break
        found.sort()
        m = len(found)
        chunks = sum(not k or found[k] != (found[k - 1][0] + 1, found[k - 1][1] + 1) for k in range(m))
        want = m and m / len(h) * m / len(r) / (0.9 * m / len(h) + 0.1 * m / len(r)) * (1 - 0.5 * (chunks / m) ** 3)
        assert evaluation.meteor(h, r, stem, synonyms) == pytest.approx(want)


def test_long_conversations_have_pairs_of_their_own(spark):
    turns = [(1, 1000, "user", "a"), (1, 1001, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d")]
    got = corpus.turn_pairs(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).collect()
    assert sorted(r["target"] for r in got) == ["b", "d"] and len({r["pair_id"] for r in got}) == 2


def test_bootstrap_median(spark):
    df = spark.range(200).select("id", (F.col("id") % 10).cast("double").alias("v"))
    one = evaluation.bootstrap_median(df, "id", ["v"]).first()["v"]
    assert abs(one - 4.5) < 0.1 and one == evaluation.bootstrap_median(df.repartition(7), "id", ["v"]).first()["v"]
    assert evaluation.bootstrap_median(df.limit(0), "id", ["v"]).first()["v"] is None


def test_reports(spark):
    board = reports.leaderboard(spark.createDataFrame([("we", 5)], "system string, score int"), spark.createDataFrame([("b", 5), ("a", 7), ("c", None)], "system string, score int"), "system", "score")
    assert [(r["system"], r["gap"]) for r in board.orderBy("rank").collect()] == [("a", 0), ("we", -2), ("b", -2), ("c", None)]
    rows = reports.all_ok(spark.createDataFrame([("x", True), ("x", None), ("y", True)], "k string, ok boolean"), "ok", "k").collect()
    assert {(r["k"], r["n"], r["n_bad"], r["ok"]) for r in rows} == {("x", 2, 1, False), ("y", 1, 0, True), (None, 3, 1, False)}
    assert column(spark, ["1.005", None, "12"], lambda c: reports.shown(c.cast("double"), 1)) == ["1.0", "-", "12.0"]


def test_distances():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                common[i][j] = max(common[i - 1][j], common[i][j - 1], common[i - 1][j - 1] + (a[i - 1] == b[j - 1]))
        assert evaluation.edits(a, b) == table[-1][-1] and evaluation.lcs(a, b) == common[-1][-1]
        assert evaluation.shifted_edits(a, b) <= table[-1][-1]
    assert SequenceMatcher(None, "ab", "ab").ratio() == 1
    assert evaluation.shifted_edits("c d a b".split(), "a b c d".split()) == 1
    assert evaluation.shifted_edits([], ["a"]) == 1 and evaluation.shifted_edits(["a"], ["a"]) == 0
    assert evaluation.meteor(["a"], ["b"]) == 0 and evaluation.meteor("a b c".split(), "a b c".split()) == pytest.approx(1 - 0.5 / 27)


def test_sweep_ties_and_nulls(spark):
    grid = spark.createDataFrame([("a", "x", 0, None, 2.0), ("a", "y", 1, 1.0, 1.0), ("a", "z", 2, 1.0, 0.5), ("b", "x", 0, None, 3.0), ("c", "x", 0, None, None)], "task string, lr string, lr_index int, eval_loss double, train_loss double")
    assert {x["task"]: x["lr"] for x in prefs.best_rate(grid).collect()} == {"a": "y", "b": None, "c": None}
    assert {x["task"]: (x["lr"], x["metric_used"]) for x in prefs.best_rate(grid, True).collect()} == {"a": ("y", "eval_loss"), "b": ("x", "train_loss"), "c": (None, None)}


def test_ordered_lines(spark, tmp_path):
    df = spark.createDataFrame([(3, "c\nd"), (1, "a"), (2, " b ")], "id long, t string")
    assert submission.write_lines(df, "id", "t", str(tmp_path / "out")) == 3
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "a\nb\nc d\n"
    for bad in ([(1, "a"), (3, "b")], [(1, "a"), (1, "b")], [(1, " ")]):
        with pytest.raises(ValueError):
            submission.write_lines(spark.createDataFrame(bad, "id long, t string"), "id", "t", str(tmp_path / "bad"))


def sheet(path, rows, shared=()):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData><row><c r='A1'><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(shared)}</sst>")


def test_xlsx(spark, tmp_path):
    rows = ["<row><c r='A1' t='s'><v>0</v></c><c r='C1' t='inlineStr'><is><t>in</t></is></c></row>", "<row></row>", "<row><c r='B3'><v>1.5</v></c><c r='AA3' t='b'><v>1</v></c></row>"]
    sheet(tmp_path / "a.xlsx", rows, ["<si><r><t>ri</t></r><r><t>ch</t></r></si>"])
    sheet(tmp_path / "b.xlsx", [])
    (tmp_path / "~$a.xlsx").write_text("lock")
    spark.dataSource.register(xlsx.XlsxRows)
    got = spark.read.format("xlsx_rows").load(str(tmp_path)).orderBy("row_no").collect()
    assert [(x["row_no"], x["cells"]) for x in got] == [(1, {0: "rich", 2: "in"}), (2, {}), (3, {1: "1.5", 26: "1"})]


def test_json_shapes(spark, tmp_path):
    objects = [{"predict": "é", "x": 1}, {"label": None}]
    (tmp_path / "a.json").write_text(json.dumps(objects))
    (tmp_path / "b.json").write_text("\n\n".join(json.dumps(x) for x in objects))
    (tmp_path / "c.json").write_text("".join(json.dumps(x, indent=1) for x in objects) + "\n")
    (tmp_path / "d.json").write_text(" ")
    got = records.read_records(spark, str(tmp_path)).orderBy("path", "row_no").collect()
    assert [json.loads(x["record"]) for x in got] == objects * 3
    (tmp_path / "dict").mkdir()
    (tmp_path / "dict/d.json").write_text('{" Water ": 1, "water": 2, "": 3}')
    assert [x["word"] for x in records.dictionary_words(spark, str(tmp_path / "dict")).collect()] == ["water"]


def test_resume(spark, tmp_path):
    out = str(tmp_path / "out")
    done = []

    def work(df):
        done.append(df.count())
        return df.withColumn("v", F.col("id") * 2)

    assert records.run_remaining(spark.range(5), "id", out, work).count() == 5
    assert records.run_remaining(spark.range(8), "id", out, work).count() == 8
    assert done == [5, 3]


def test_stream_appends_new_files_once(spark, tmp_path):
    args = (spark, str(tmp_path / "in"), "id long", lambda df: df.where("id % 2 = 0"), str(tmp_path / "out"), str(tmp_path / "check"))
    for part in (spark.range(4), spark.range(4, 8)):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        resume.append_new(*args)
        resume.append_new(*args)
    assert sorted(x["id"] for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6]


def cells_of(spark, *sheets):
    rows = [(name, i, dict(enumerate(cells))) for name, rows in sheets for i, cells in enumerate(rows, 1)]
    return spark.createDataFrame(rows, parallel.CELLS)


@pytest.mark.parametrize(
    ("header", "first", "side", "is_header"),
    [("any", ["Bodo", " English text "], 1, True), ("any", ["x", "English " * 9], 1, True), ("short", ["x", "English " * 9], 0, False), ("short", ["a", "English"], 1, True), ("exact", ["English text", "é"], 0, False), ("exact", ["é", " ENGLISH "], 1, True),
     ("always", ["English", "English"], 0, True), ("always", ["target", "the source"], 1, True), ("always", ["x", "english"], 1, True), ("always", [None, None], 0, True), ("any", ["é", "e"], 1, False), ("any", [None, None], 0, False)],
)
def test_english_side(spark, header, first, side, is_header):
    one = parallel.english_side(cells_of(spark, ("f", [first])), header).first()
    assert (one["side"], one["has_header"]) == (side, is_header)


def test_sheet_pairs_and_tests(spark):
    rows = cells_of(spark, ("a", [["Bodo", "English"], [" b ", " e "], [None, "e"], ["  ", "e"], ["b2", "e2"]]), ("b", [["plain", "é"], ["more", "éé"]]))
    got = parallel.sheet_pairs(rows).orderBy("path", "row_no").collect()
    assert [(r["path"], r["row_no"], r["english"], r["target"]) for r in got] == [("a", 2, "e", "b"), ("a", 5, "e2", "b2"), ("b", 1, "plain", "é"), ("b", 2, "more", "éé")]
    rows = cells_of(spark, ("t", [["Sentence", "S No", "English Sentences"], ["no", "3.0", "x"], ["no", "4", " "], ["no", None, "y"], ["no", "z", "w"]]), ("u", [["a", "b"], ["7", "v"]]))
    got = parallel.test_rows(rows).orderBy("path", "id", "english").collect()
    assert [(r["path"], r["id"], r["english"]) for r in got] == [("t", 2, "y"), ("t", 3, "w"), ("t", 3, "x"), ("u", 7, "v")]


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"water": {"samples_used": 2, "total_pairs": 3, "candidates": [{"target": "x", "probability": 0.5}, {"target": None, "probability": "abc"}], "note": "n"}, "none": {"candidates": []}}))
    got = parallel.word_vocabulary(spark, str(tmp_path / "w.json")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [("water", 1, "x", "0.5"), ("water", 2, None, "abc")]
    index = [{"a": [{"e1": "t1"}, {"e2": "t2"}]}, {"b": [{"e": "t"}]}, {"a": [{"last": "wins"}]}]
    (tmp_path / "s.json").write_text(json.dumps(index))
    (tmp_path / "o.json").write_text(json.dumps({"b": [{"e": "t"}]}))
    got = parallel.sentence_vocabulary(spark, str(tmp_path / "s.json")).orderBy("word").collect()
    assert [tuple(r) for r in got] == [("a", 0, "last", "wins"), ("b", 0, "e", "t")]
    assert [tuple(r) for r in parallel.sentence_vocabulary(spark, str(tmp_path / "o.json")).collect()] == [("b", 0, "e", "t")]
    (tmp_path / "r.json").write_text(json.dumps({"sft": {"file_name": "f.json"}, "dpo": {"file_name": "g.json", "ranking": True, "formatting": "sharegpt", "columns": {}}}))
    assert {tuple(r) for r in parallel.registry(spark, str(tmp_path / "r.json")).collect()} == {("sft", "f.json", None, None), ("dpo", "g.json", "sharegpt", True)}
    assert parallel.existing(spark, str(tmp_path / "absent"), str(tmp_path / "o.json")) == str(tmp_path / "o.json")
    assert parallel.existing(spark, str(tmp_path / "absent")) is None


def test_prediction_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"predict": " p ", "label": "l"}, {"predict": None, "tagin": "t"}, {"prediction": "q"}, {"x": 1}]))
    got = parallel.predictions(spark, str(tmp_path / "p.json")).orderBy("row_no").collect()
    assert [(r["predict"], r["label"]) for r in got] == [("p", "l"), ("", ""), ("q", ""), ("", "")]
    (tmp_path / "i.json").write_text(json.dumps([{"instruction": "head\n\nhints\n\ne", "output": "o"}, {"instruction": "only", "output": ""}]))
    assert [(r["english"], r["target"]) for r in parallel.instruction_pairs(spark, str(tmp_path / "i.json")).collect()] == [("hints\n\ne", "o")]
    (tmp_path / "m").mkdir()
    for name, text in (("a", '{"eval_loss": 1.5, "epoch": 2}'), ("b", "{broken"), ("c", "[]")):
        (tmp_path / "m" / name).write_text(text)
    got = parallel.run_metrics(spark, str(tmp_path / "m")).orderBy("path").collect()
    assert [(r["eval_loss"], r["epoch"]) for r in got] == [(1.5, 2.0), (None, None), (None, None)]
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": }')
    with pytest.raises(Exception, match="bad.json, line 2"):
        records.read_records(spark, str(tmp_path / "bad.json")).collect()
    assert column(spark, ["/x/en-Bodo_final_test.json", "/x/zz_final.json"], lambda c: parallel.language_of_path(c, ["bodo"])) == ["bodo", "zz"]


def test_text_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\r\n\nlast\n".encode())
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"")
    got = parallel.text_lines(spark, str(tmp_path)).orderBy("path", "line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "é\r"), (2, ""), (3, "last"), (1, "x")]


def test_record_sinks(spark, tmp_path):
    objects = [{"chosen": {"from": "sft", "value": "é"}, "rejected": {"from": "gpt"}, "own": [1, None]}, {"chosen": "text"}, 5]
    (tmp_path / "in.json").write_text(json.dumps(objects))
    got = parallel.rewrite_records(records.read_records(spark, str(tmp_path / "in.json"))).orderBy("row_no")
    assert [(r["n_fixed"], r["n_ok"], r["n_missing"]) for r in got.collect()] == [(1, 1, 0), (0, 0, 2), (0, 0, 2)]
    for kind in ("lines", "array"):
        parallel.write_records(got, str(tmp_path / kind), kind=kind)
        text = "".join(f.read_text() for f in sorted((tmp_path / kind).glob("part-*")))
        back = json.loads(text) if kind == "array" else list(records.json_objects(text))
        assert back == [{"chosen": {"from": "gpt", "value": "é"}, "rejected": {"from": "gpt"}, "own": [1, None]}, {"chosen": "text"}, 5]
    parallel.write_records(got.limit(0), str(tmp_path / "none"), kind="array")
    assert "".join(f.read_text() for f in (tmp_path / "none").glob("part-*")).strip() == "[]"


def test_calls_and_merge(spark):
    """Failures and replies that aren't JSON are tried again after longer and longer waits, blocked prompts aren't."""
    waited = []
    prompts = spark.createDataFrame([(1, "late"), (2, "broken"), (3, "blocked"), (4, "down")], "id int, prompt string").coalesce(1)

    def send(prompt):
        seen[prompt] = seen.get(prompt, 0) + 1
        return {"late": ("throttled", "") if seen[prompt] < 3 else ("ok", '{"a": 1}'), "broken": ("ok", "{"), "blocked": ("blocked", ""), "down": ("error", "")}[prompt]

    seen = {}
    got = {r["id"]: (r["status"], r["reply"]) for r in generation.calls(prompts, "id", "prompt", send).collect()}
    assert got == {1: ("ok", '{"a": 1}'), 2: ("parse_err", None), 3: ("blocked", None), 4: ("neterr", None)}
    log = spark.createDataFrame([(1, "late")], "id int, prompt string")

    def slept(seconds):
        waited.append(seconds)
        if waited == [2.0, 4.0]:
            raise RuntimeError("waited 2 and 4 seconds")

    with pytest.raises(Exception, match="waited 2 and 4 seconds"):
        generation.calls(log, "id", "prompt", send, wait=1.0, sleep=slept).collect()
    cands = [{"target": " a ", "probability": "0.25"}, {"target": "b", "probability": 2}, {"target": "", "probability": 1}, None, {"target": "c", "probability": "x"}, {"target": "d"}, {"target": "e", "probability": -1}]
    replies = [{"candidates": cands}, {"candidates": None}, {"candidates": [{"target": "a", "probability": 0.5}, {"target": "f", "probability": 0.5}]}, [1]]
    rows = spark.createDataFrame([("w", i, json.dumps(x)) for i, x in enumerate(replies)], "word string, place int, reply string")
    got = generation.merge_candidates(rows, "word", "place", "reply").first()["candidates"]
    assert [(c["target"], c["probability"]) for c in got] == [("b", 1.0), ("a", 0.5), ("f", 0.5), ("e", 0.0)]


def test_recover_words(spark):
    """The first phase asks at most 8 different samples, the second every one of the first pairs."""
    pairs = spark.createDataFrame([(i, f"e{i}", f"t{i}") for i in range(30)], "pair_id long, english string, target string")
    index = spark.createDataFrame([("good", i) for i in range(30)] + [("hard", i) for i in range(30)] + [("few", i) for i in range(2)] + [("never", 1)], "word string, pair_id long")

    def send(prompt):
        if "few" in prompt or "never" in prompt:
            return "neterr", ""
        if '"hard"' in prompt and "2. EN" in prompt:
            return "blocked", ""
        return "ok", json.dumps({"candidates": [{"target": str(prompt.count("EN: ")), "probability": 0.7}]})

    got = {r["word"]: r for r in generation.recover_words(index, pairs, send, "X", k=5).collect()}
    assert [(w, got[w]["samples_used"], got[w]["total_pairs"], got[w]["n_ok"], got[w]["n_blocked"], got[w]["n_failed"]) for w in sorted(got)] == [("few", 2, 2, 0, 0, 3), ("good", 5, 30, 1, 0, 0), ("hard", 5, 30, 5, 8, 0), ("never", 1, 1, 0, 0, 2)]
    assert [c["target"] for c in got["good"]["candidates"]] == ["5"] and [c["target"] for c in got["hard"]["candidates"]] == ["1"]


def test_rejected(spark):
    df = spark.createDataFrame([(1, "p", " c "), (2, "q", None)], "id int, prompt string, chosen string")
    got = generation.rejected(df, "id", "prompt", "chosen", lambda ps, attempt: ["c" if p == "p" else "" for p in ps], tries=3).orderBy("id").collect()
    assert [(r["attempts"], r["status"]) for r in got] == [(3, "failed"), (3, "failed")]


def test_places(spark):
    a, b = spark.createDataFrame([(-5,), (9,), (10**12,)], "a long"), spark.createDataFrame([(3, "x"), (1, "y")], "b long, s string")
    got = corpus.zipped(a, "a", b, "b").orderBy("place").collect()
    assert [(r["place"], r["a"], r["s"]) for r in got] == [(1, -5, "y"), (2, 9, "x")]
    assert corpus.zipped(a.limit(0), "a", b, "b").count() == 0
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "b"), (None, 9, "c")], "k string, at int, v string")
    assert [tuple(r) for r in corpus.last_of(rows, "k", "at").collect()] == [("k", 3, None)]


def test_null_keys_keep_their_rows(spark):
    rows = spark.createDataFrame([(None, "a"), (2, "b"), (1, "c"), (None, "d")], "k long, v string")
    assert sorted(r["place"] for r in corpus.hash_order(rows, F.col("k")).collect()) == [1, 2, 3, 4]
    assert corpus.split(rows, F.col("k"), 0.5).groupBy("split").count().orderBy("split").collect() == [("test", 2), ("train", 2)]
    assert [(r["place"], r["k"]) for r in corpus.placed(rows, "k").orderBy("place").collect()] == [(1, None), (2, None), (3, 1), (4, 2)]
    assert corpus.zipped(rows, "k", rows.withColumnsRenamed({"k": "j", "v": "w"}), "j").count() == 4


def test_repair_with_collapse(spark):
    """Collapse, cap and n-gram stop in one pass: the cap is on kept tokens, n-grams are the whole text's."""
    texts = ["a a b c", "a b c a b c d", "a a a a", "a  b c", "x x a b c y a b c", "p q p p q r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = {r["i"]: r["fixed"] for r in evaluation.decode_fix(df, "s", collapse=True).collect()}
    assert got == {0: "a b c", 1: "a b c a b", 2: "a", 3: "a  b c", 4: "x a b c y a b", 5: "p q p q r"}
    short = {r["i"]: r["fixed"] for r in evaluation.decode_fix(df, "s", collapse=True, cap=2).collect()}
    assert short == {0: "a b", 1: "a b", 2: "a", 3: "a b", 4: "x a", 5: "p q"}


def test_clipped_matches_by_counting(spark):
    import random
    from collections import Counter

    rng = random.Random(1)
    rows = [(i % 2, " ".join(rng.choices("abc", k=rng.randint(0, 9))), " ".join(rng.choices("abc", k=rng.randint(0, 9)))) for i in range(60)] + [(0, None, "a"), (1, "b", None)]
    df = spark.createDataFrame(rows, "g int, h string, r string")
    tokens = df.select("g", F.split("h", " ").alias("h"), F.split("r", " ").alias("r"))
    want = {}
    for g, h, r in rows:
        for n in range(1, 4):
            grams = [Counter(tuple(x.split(" ")[i : i + n]) for i in range(len(x.split(" ")) - n + 1)) if x is not None else Counter() for x in (h, r)]
            old = want.get((g, n), (0, 0, 0))
            want[g, n] = tuple(a + b for a, b in zip(old, ((grams[0] & grams[1]).total(), grams[0].total(), grams[1].total())))
    got = {(x["g"], x["n"]): (x["matches"], x["hyp_total"], x["ref_total"]) for x in evaluation.clipped_matches(tokens, [("h", "r", 3)], ("g",)).collect()}
    assert got == want


def test_console_and_sizes(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, 2), ("long name", None, None)], "name string, x double, n int")
    assert reports.console(df) == "name       x     n\na          1.50  2\nlong name  -     -"
    (tmp_path / "f").write_bytes(b"12345")
    got = reports.sizes(spark, [str(tmp_path / "f"), str(tmp_path / "none")]).collect()
    assert [(x["found"], x["bytes"]) for x in got] == [(True, 5), (False, None)]


def test_candidates_without_a_number_go(spark):
    df = spark.createDataFrame([("a", "0.5"), ("b", "x"), ("c", None), ("", "0.1"), ("d", "-1"), ("e", "2")], "t string, p string")
    assert [(r["target"], r["p_bp"]) for r in corpus.clean_candidates(df, "t", F.col("p")).orderBy("t").collect()] == [("a", 5000), ("d", 0), ("e", 10000)]
