"""The library's queries by name, each with DuckDB SQL for the same rows where SQL can express it.

There is no parallel corpus among the tables: a user turn of a conversation and
the assistant turn after it serve as a sentence pair, the words of the
benchmark as the dictionary, and orders grouped by priority and status as the
results of a sweep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions import text as T
from ..operators import corpus, evaluation, generation, prefs, reports, submission
from ..sources import parallel, records, working, xlsx

QUERIES: dict = {}
SQL: dict[str, str] = {}

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MARKS = r"""([!"#$%&''()*+,\-./:;<=>?@\[\]^_`{|}~\x{964}\x{965}\x{aaf1}\x{aaf0}\x{abeb}\x{abec}\x{abed}\x{abee}\x{abef}\x{1c7e}\x{1c7f}])"""
_QE = r"[\p{L}\p{N}]+(?:[-''/][\p{L}\p{N}]+)*|[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\p{L}\p{N}_]"


def _strip(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '{_SPACE}'), lambda t: lower(regexp_replace(t, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))), lambda t: t <> '')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _indic(x: str) -> str:
    apart = f"regexp_replace(translate(regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g'), chr(9), ' '), '{_MARKS}', ' \\1 ', 'g')"
    out = f"trim(regexp_replace({apart}, '[ ]+', ' ', 'g'))"
    for _ in range(2):
        out = f"regexp_replace({out}, '([0-9]) ([,.:/]) ([0-9])', '\\1\\2\\3', 'g')"
    return f"string_split({out}, ' ')"


def _13a(x: str) -> str:
    out = f"lower(replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '))"
    for mark, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{mark}', '{char}')"
    out = f"(' ' || {out} || ' ')"
    out = f"regexp_replace({out}, '([{{-~\\[-` -&(-+:-@/])', ' \\1 ', 'g')"
    out = f"regexp_replace({out}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    out = f"regexp_replace({out}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    out = f"regexp_replace({out}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return f"list_filter(string_split_regex({out}, '{_SPACE}'), lambda t: t <> '')"


def _grams(list_: str, n: str) -> str:
    return f"list_transform(range(1, greatest(len({list_}) - {n} + 2, 1)), lambda i: array_to_string({list_}[i : i + {n} - 1], ' '))"


_PAIR = "pair AS (SELECT u.conv_id * 1048576 + u.turn AS pair_id, u.turn, u.text AS english, a.text AS target FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"
_DICT = f"dict AS (SELECT DISTINCT unnest({_strip('text')}) AS word FROM benchmark)"
_POST = f"post AS (SELECT word, pair_id FROM (SELECT pair_id, unnest(list_distinct({_strip('english')})) AS word FROM pair) SEMI JOIN dict USING (word))"
_LEX = f"""e AS (SELECT p.pair_id, p.word FROM post p), t AS (SELECT pair_id, unnest(list_distinct({_strip('target')})) AS target FROM pair),
cw AS (SELECT word, count(*) AS n_word FROM e GROUP BY word), ct AS (SELECT target, count(*) AS n_target FROM t GROUP BY target),
lex AS (SELECT word, target, count(*) AS n_both, any_value(n_word) AS n_word, any_value(n_target) AS n_target, CAST(floor(20000 * count(*) / (any_value(n_word) + any_value(n_target))) AS BIGINT) AS p_bp FROM e JOIN t USING (pair_id) JOIN cw USING (word) JOIN ct USING (target) GROUP BY word, target),
top AS (SELECT * FROM (SELECT word, target, p_bp, row_number() OVER (PARTITION BY word ORDER BY p_bp DESC, target) AS rank FROM lex WHERE p_bp >= 5000) WHERE rank <= 3)"""
_PCT = "CAST(CAST(floor(floor(p_bp / 100) / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor(p_bp / 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')"
_HEAD = "Translate the following segment into Target, without additional explanation."


def _query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _pairs(t) -> DataFrame:
    return corpus.turn_pairs(t("conversations"))


def _dict(t) -> DataFrame:
    return corpus.dictionary(t("benchmark"))


def _index(t) -> DataFrame:
    return corpus.postings(_pairs(t), _dict(t))


def _lexicon(t) -> DataFrame:
    return corpus.cooccurrence(_pairs(t), _dict(t))


def _prompts(t) -> DataFrame:
    return corpus.instructions(_pairs(t), corpus.top_candidates(_lexicon(t)), "Target")


@_query(f"WITH {_DICT} SELECT word FROM dict")
def vocab_dictionary(t):
    return _dict(t)


@_query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_strip('text')} AS w FROM documents)")
def strip_tokens(t):
    w = T.strip_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("tokens_md5"))


@_query(f"SELECT doc_id, CAST(len(list_distinct({_strip('text')})) AS BIGINT) AS n_unique FROM documents")
def unique_tokens(t):
    return t("documents").select("doc_id", F.size(T.unique_tokens(F.col("text"))).cast("long").alias("n_unique"))


@_query(r"SELECT lang, CAST(sum(length(regexp_replace(text, '[^\x00-\x7f]', '', 'g'))) AS BIGINT) AS ascii_chars, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def ascii_ratio_by_lang(t):
    return t("documents").groupBy("lang").agg(F.sum(T.ascii_chars(F.col("text"))).alias("ascii_chars"), F.sum(F.length("text")).alias("chars"))


@_query(f"WITH {_PAIR} SELECT CAST(sum(length(regexp_replace(english, '[^\\x00-\\x7f]', '', 'g'))) AS BIGINT) * CAST(sum(length(target)) AS BIGINT) >= CAST(sum(length(regexp_replace(target, '[^\\x00-\\x7f]', '', 'g'))) AS BIGINT) * CAST(sum(length(english)) AS BIGINT) AS first_is_english FROM (SELECT * FROM pair ORDER BY pair_id LIMIT 30)")
def english_column_vote(t):
    """The column with the larger share of ASCII in the first 30 rows, the first on a tie."""
    head = _pairs(t).orderBy("pair_id").limit(30)
    a, b = F.sum(T.ascii_chars(F.col("english"))), F.sum(T.ascii_chars(F.col("target")))
    return head.agg((a * F.sum(F.length("target")) >= b * F.sum(F.length("english"))).alias("first_is_english"))


@_query("SELECT DISTINCT lang, upper(lang[1]) || lang[2:] AS language FROM documents")
def lang_from_filename(t):
    name = F.concat(F.lit("English - "), "lang", F.lit("  Training Data 2026.xlsx"))
    return t("documents").select("lang", T.language_of_file(name).alias("language")).distinct()


@_query("SELECT n_nationkey, CAST((ascii(n_name[1]) - 64) * 26 + ascii(n_name[2]) - 65 AS INTEGER) AS column_index FROM nation")
def a1_column_index(t):
    ref = F.concat(F.substr("n_name", F.lit(1), F.lit(2)), F.col("n_nationkey").cast("string"))
    return t("nation").select("n_nationkey", T.column_index(ref).alias("column_index"))


@_query(f"SELECT doc_id, length({_clean('text')}) AS n, md5({_clean('text')}) AS clean_md5 FROM documents")
def sanitize_text(t):
    s = T.sanitize(F.col("text"))
    return t("documents").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s).alias("clean_md5"))


@_query(f"WITH {_PAIR} SELECT pair_id, md5(regexp_replace(regexp_extract('{_HEAD}' || chr(10) || chr(10) || target, '\\n\\n((?s).*)', 1), '^{_SPACE}|{_SPACE}$', '', 'g')) AS english_md5 FROM pair")
def first_segment_english(t):
    s = F.concat(F.lit(_HEAD + "\n\n"), "target")
    return _pairs(t).select("pair_id", F.md5(T.first_segment_rest(s)).alias("english_md5"))


@_query(f"WITH {_PAIR} SELECT pair_id, md5(regexp_replace(string_split(english || chr(10) || chr(10) || target, chr(10) || chr(10))[-1], '^{_SPACE}|{_SPACE}$', '', 'g')) AS source_md5 FROM pair")
def last_segment_source(t):
    return _pairs(t).select("pair_id", F.md5(T.last_segment(F.concat("english", F.lit("\n\n"), "target"))).alias("source_md5"))


@_query("SELECT conv_id, turn, md5(text) AS hyp_md5 FROM conversations")
def coalesce_hypothesis(t):
    c = t("conversations").select("conv_id", "turn", *[F.when(F.col("role") == r, F.col("text")).alias(n) for r, n in (("user", "predict"), ("assistant", "tagin"), ("system", "prediction"))])
    return c.select("conv_id", "turn", F.md5(F.coalesce("predict", "tagin", "prediction", F.raise_error(F.lit("no prediction field")).cast("string"))).alias("hyp_md5"))


@_query(f"WITH {_PAIR} SELECT count(*) AS n_rows, count_if({_clean('english')} <> '' AND {_clean('target')} <> '') AS n_pairs, count_if(NOT ({_clean('english')} <> '' AND {_clean('target')} <> '')) AS n_skipped FROM pair")
def valid_pairs(t):
    ok = corpus.valid()
    return _pairs(t).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_pairs"), F.count_if(~ok).alias("n_skipped"))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, pair_id FROM post")
def vocab_inverted_index(t):
    return _index(t)


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, count(*) AS n_pairs FROM post GROUP BY word")
def vocab_index_counts(t):
    return corpus.word_counts(_index(t))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT count(DISTINCT word) AS n_words, count(*) AS n_entries FROM post")
def index_stats(t):
    return corpus.word_counts(_index(t)).agg(F.count(F.lit(1)).alias("n_words"), F.sum("n_pairs").alias("n_entries"))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, count(*) AS n_pairs FROM post GROUP BY word HAVING count(*) >= 2")
def eligible_words(t):
    return corpus.eligible(_index(t))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, n_pairs FROM (SELECT word, count(*) AS n_pairs FROM post GROUP BY word HAVING count(*) >= 2) ANTI JOIN (SELECT DISTINCT unnest({_strip('text')}) AS word FROM conversations WHERE role = 'system') USING (word) ORDER BY word LIMIT 50")
def todo_words_limit(t):
    """The first 50 eligible words that aren't done; those of system turns count as done."""
    done = corpus.dictionary(t("conversations").where("role = 'system'"))
    return corpus.eligible(_index(t)).join(done, "word", "left_anti").orderBy("word").limit(50)


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word FROM (SELECT word FROM post GROUP BY word HAVING count(*) >= 2) EXCEPT SELECT DISTINCT unnest({_strip('text')}) FROM conversations WHERE role = 'system'")
def eligible_except_done(t):
    return corpus.eligible(_index(t)).select("word").exceptAll(corpus.dictionary(t("conversations").where("role = 'system'")))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST}, {_LEX} SELECT word, target, n_both, n_word, n_target, p_bp FROM lex")
def cooccur_lexicon(t):
    return _lexicon(t)


@_query(f"WITH {_PAIR}, {_DICT}, {_POST}, {_LEX} SELECT word, target, p_bp, CAST(rank AS INTEGER) AS rank FROM top")
def topk_candidates(t):
    return corpus.top_candidates(_lexicon(t)).select("word", "target", "p_bp", "rank")


@_query("SELECT c_custkey, c_mktsegment AS target, CAST(floor(10000 * least(greatest(c_acctbal / 5000, 0.0), 1.0)) AS BIGINT) AS p_bp FROM customer")
def candidate_clean(t):
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") / 5000).cast("string").alias("probability"))
    return corpus.clean_candidates(c, "target", F.col("probability")).select("c_custkey", "target", "p_bp")


@_query("SELECT c_nationkey AS word, c_mktsegment AS target, max(CAST(floor(10000 * least(greatest(c_acctbal / 5000, 0.0), 1.0)) AS BIGINT)) AS p_bp FROM customer GROUP BY ALL")
def candidate_merge_max(t):
    c = t("customer").select(F.col("c_nationkey").alias("word"), F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") / 5000).cast("string").alias("probability"))
    return corpus.clean_candidates(c, "target", F.col("probability")).groupBy("word", "target").agg(F.max("p_bp").alias("p_bp"))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, pair_id FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY md5('42-' || word || '|' || CAST(pair_id AS VARCHAR)), pair_id) AS r FROM post) WHERE r <= 10")
def word_pair_sample(t):
    return corpus.sample_per_key(_index(t), "word", F.col("pair_id"))


_PROMPT = f"""tok AS (SELECT pair_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT pair_id, {_strip('english')} AS w FROM pair)),
firsts AS (SELECT pair_id, word, min(pos) AS pos FROM tok GROUP BY ALL),
shown AS (SELECT word, string_agg(target || ' (' || {_PCT} || ')', ' / ' ORDER BY rank) AS shown FROM top GROUP BY word),
line AS (SELECT pair_id, count(*) AS n, string_agg('- ' || word || ': ' || shown, chr(10) ORDER BY pos) AS block FROM firsts JOIN shown USING (word) GROUP BY pair_id),
prompt AS (SELECT pair_id, coalesce(n, 0) AS n_hints, '{_HEAD}' || chr(10) || chr(10) || coalesce('Helpful Target vocabulary for words in this sentence:' || chr(10) || block || chr(10) || chr(10), '') || english AS instruction FROM pair LEFT JOIN line USING (pair_id))"""


@_query(f"WITH {_PAIR}, {_DICT}, {_POST}, {_LEX}, {_PROMPT} SELECT pair_id, n_hints, md5(instruction) AS instruction_md5 FROM prompt")
def vocab_hint_prompts(t):
    return _prompts(t).select("pair_id", "n_hints", F.md5("instruction").alias("instruction_md5"))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST}, {_LEX}, {_PROMPT} SELECT count(*) AS n_prompts, count_if(contains(instruction, 'Helpful')) AS n_with_hint, CAST(sum((length(instruction) - length(replace(instruction, chr(10) || '- ', ''))) // 3) AS BIGINT) AS n_lines, CAST(sum(n_hints) AS BIGINT) AS n_hints FROM prompt")
def hint_coverage(t):
    i = F.col("instruction")
    return _prompts(t).agg(F.count(F.lit(1)).alias("n_prompts"), F.count_if(F.contains(i, F.lit("Helpful"))).alias("n_with_hint"), F.sum(F.regexp_count(i, F.lit("\n- "))).alias("n_lines"), F.sum("n_hints").alias("n_hints"))


@_query(f"WITH {_PAIR}, {_DICT}, {_POST} SELECT word, count(*) AS n, md5(string_agg(CAST(r AS VARCHAR) || '. EN: ' || english || chr(10) || '   Target: ' || target, chr(10) ORDER BY r)) AS lines_md5 FROM (SELECT word, pair_id, row_number() OVER (PARTITION BY word ORDER BY md5('42-' || word || '|' || CAST(pair_id AS VARCHAR)), pair_id) AS r FROM post) JOIN pair USING (pair_id) WHERE r <= 10 GROUP BY word")
def alignment_prompt(t):
    """Numbered sentence pairs of each word, ten at most."""
    sampled = corpus.sample_per_key(_index(t), "word", F.col("pair_id")).join(_pairs(t), "pair_id")
    order = F.struct(F.md5(F.concat(F.lit("42-"), "word", F.lit("|"), F.col("pair_id").cast("string"))).alias("h"), "pair_id", "english", "target")
    lists = sampled.groupBy("word").agg(F.array_sort(F.collect_list(order)).alias("p"))  # ten at most
    lines = F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". EN: "), x["english"], F.lit("\n   Target: "), x["target"]))
    return lists.select("word", F.size("p").cast("long").alias("n"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"))


@_query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN '{\"word\": \"' || c_mktsegment || '\", \"candidates\": []}' END AS found FROM customer")
def extract_llm_json(t):
    """Replies with fences and prose around an object; those without a closing brace have none."""
    body = F.concat(F.lit('{"word": "'), "c_mktsegment", F.lit('", "candidates": []'), F.when(F.col("c_acctbal") >= 0, "}").otherwise(""))
    return t("customer").select("c_custkey", T.json_object_in(F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).alias("found"))


_SPLIT = f"WITH {_PAIR}, s AS (SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || CAST(pair_id AS VARCHAR)), pair_id) <= (SELECT round_even(count(*) * 0.8, 0) FROM pair) THEN 'train' ELSE 'test' END AS split FROM pair)"


@_query(f"{_SPLIT} SELECT pair_id, split FROM s")
def train_test_split(t):
    return corpus.split(_pairs(t).select("pair_id"), F.col("pair_id"))


@_query(f"{_SPLIT} SELECT split, count(*) AS n FROM s GROUP BY ROLLUP (split)")
def split_counts(t):
    return corpus.split(_pairs(t).select("pair_id"), F.col("pair_id")).rollup("split").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_SPLIT} SELECT pair_id, split FROM s WHERE split = 'train' UNION ALL SELECT pair_id, split FROM s WHERE split = 'test'")
def union_all_merge(t):
    s = corpus.split(_pairs(t).select("pair_id"), F.col("pair_id"))
    return s.where("split = 'train'").unionByName(s.where("split = 'test'"))


@_query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def id_intersect(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id"))


@_query(f"SELECT count(DISTINCT word) AS n_words FROM (SELECT unnest({_strip('text')}) AS word FROM documents)")
def distinct_tokens(t):
    return t("documents").select(F.explode(T.unique_tokens(F.col("text"))).alias("word")).agg(F.countDistinct("word").alias("n_words"))


@_query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE CAST(o_custkey AS BIGINT) END AS id FROM orders")
def test_ids(t):
    """Serial numbers like 17.0, else a fallback."""
    number = F.when(F.col("o_orderstatus") == "F", F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).otherwise("n/a")
    return t("orders").select("o_orderkey", submission.test_id(number, F.col("o_custkey")).alias("id"))


@_query("SELECT 'orders' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS n_distinct, min(o_orderkey) AS least, max(o_orderkey) AS most, count(*) = count(DISTINCT o_orderkey) AND min(o_orderkey) = 1 AND max(o_orderkey) = count(*) AS ok FROM orders UNION ALL SELECT 'documents', count(*), count(DISTINCT doc_id + 1), min(doc_id + 1), max(doc_id + 1), count(*) = count(DISTINCT doc_id) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 FROM documents")
def contiguous_id_check(t):
    a = submission.contiguous(t("orders"), "o_orderkey").select(F.lit("orders").alias("name"), "*")
    return a.union(submission.contiguous(t("documents").select((F.col("doc_id") + 1).alias("id")), "id").select(F.lit("documents").alias("name"), "*"))


@_query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) / ceil((SELECT count(*) FROM documents) / 8)) AS BIGINT) AS shard FROM documents")
def shard_assign(t):
    return submission.shards(corpus.hash_order(t("documents").select("doc_id"), F.col("doc_id")), "place", 8).select("doc_id", "shard")


_PLAN = "slot(slot, out_dir) AS (VALUES " + ", ".join(map(str, submission.SLOTS)) + "), lang(lang, pair) AS (VALUES " + ", ".join(map(str, submission.PAIRS)) + ")"


@_query(f"WITH {_PLAN} SELECT slot, lang, pair, CASE WHEN slot = 'contrastive2' THEN 'sft_predictions' WHEN lang = 'bodo' THEN 'sft_test_predictions' ELSE 'sft_add_predictions' END || '/' || lang || '_predicted.json' AS source, out_dir FROM slot, lang")
def plan_crossjoin(t):
    return submission.plan(t("nation").sparkSession)


_GRAM = lambda n: f"list_transform(range(1, greatest(len(h) - {n} + 2, 1)), lambda i: array_to_string(h[i : i + {n} - 1], ' '))"
_SEG = f"""seg AS (SELECT system, pair_id, lang, regexp_extract_all(hyp, '{_QE}') AS h, regexp_extract_all(src, '{_QE}') AS s FROM (SELECT 'forward' AS system, pair_id, turn AS lang, target AS hyp, english AS src FROM pair UNION ALL SELECT 'backward', pair_id, turn, english, target FROM pair)),
g AS (SELECT *, len(h) AS n, len(s) AS m, {_GRAM(2)} AS g2, {_GRAM(3)} AS g3, list_distinct(list_transform(s, lambda x: lower(x))) AS low, list_max(list_transform(h, lambda x: length(x))) AS width FROM seg),
g4 AS (SELECT *, list_filter(h, lambda x: length(x) = width)[1] AS w FROM g),
v AS (SELECT *, len(list_distinct(h)) / n AS d1, CASE WHEN n < 2 THEN 1.0 ELSE len(list_distinct(g2)) / len(g2) END AS d2, CASE WHEN n < 3 THEN 1.0 ELSE len(list_distinct(g3)) / len(g3) END AS d3,
 coalesce(list_sum(list_transform(range(1, n), lambda i: CASE WHEN h[i] = h[i + 1] THEN 1 ELSE 0 END)), 0) / n AS dup, CASE WHEN m > 0 THEN n / m ELSE 0.0 END AS ratio, len(list_filter(h, lambda x: list_contains(low, lower(x)))) / n AS copy,
 CASE WHEN width <= 25 THEN 0.0 ELSE least(1.0, (1.0 - len(list_distinct(list_transform(range(1, length(w) - 1), lambda i: w[i : i + 2]))) / (length(w) - 2)) * (length(w) / 60.0)) END AS runaway FROM g4),
q AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE 100.0 * (0.40 * greatest(0.0, least(1.0, 0.5 * d2 + 0.5 * d3 - 0.5 * dup - runaway)) + 0.30 * CASE WHEN m = 0 THEN 0.5 WHEN ratio >= 0.6 AND ratio <= 1.6 THEN 1.0 WHEN ratio < 0.6 THEN greatest(0.0, least(1.0, (ratio - 0.2) / (0.6 - 0.2))) ELSE greatest(0.0, least(1.0, (3.5 - ratio) / (3.5 - 1.6))) END + 0.20 * (1.0 - greatest(0.0, least(1.0, (copy - 0.15) / (0.65 - 0.15)))) + 0.10 * 1.0) END AS quality_raw FROM v),
qe AS (SELECT system, pair_id, lang, """ + ", ".join(f"CAST(floor(CASE WHEN n = 0 THEN 0.0 ELSE {e} END * 10000 + 0.5) AS BIGINT) AS {k}" for e, k in (("ratio", "length_ratio"), ("d1", "distinct_1"), ("d2", "distinct_2"), ("d3", "distinct_3"), ("dup", "dup_rate"), ("runaway", "runaway"), ("copy", "copy_rate"))) + """,
 CAST(floor(CASE WHEN n = 0 THEN 1.0 ELSE 1.0 - d3 END * 10000 + 0.5) AS BIGINT) AS rep3_rate, CAST(floor(quality_raw * 10000 + 0.5) AS BIGINT) AS quality, CAST(n = 0 AS INTEGER) AS empty, CAST(n > 0 AND ratio > 3.0 AS INTEGER) AS too_long, CAST(n = 0 OR ratio < 0.3 AS INTEGER) AS too_short, CAST(n > 0 AND copy > 0.6 AS INTEGER) AS untranslated FROM q)"""


def _segments(t) -> DataFrame:
    p = _pairs(t)
    a = p.select(F.lit("forward").alias("system"), "pair_id", F.col("turn").alias("lang"), F.col("target").alias("hyp"), F.col("english").alias("src"))
    b = p.select(F.lit("backward").alias("system"), "pair_id", F.col("turn").alias("lang"), F.col("english").alias("hyp"), F.col("target").alias("src"))
    return evaluation.quality_signals(a.union(b), "hyp", "src").drop("hyp", "src")


_MEANS = ["length_ratio", "distinct_1", "distinct_2", "distinct_3", "dup_rate", "copy_rate", "rep3_rate", "quality"]


def _by_lang(t) -> DataFrame:
    s = _segments(t)
    return s.groupBy("system", "lang").agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.sum(c) / F.count(F.lit(1))).cast("long").alias(c) for c in _MEANS], *[F.sum(c).alias(c) for c in ("empty", "too_long", "too_short", "untranslated")], F.count_if(F.col("runaway") > 0).alias("n_runaway"))


_LANG = "by_lang AS (SELECT system, lang, count(*) AS n, " + ", ".join(f"CAST(floor(sum({c}) / count(*)) AS BIGINT) AS {c}" for c in _MEANS) + ", " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("empty", "too_long", "too_short", "untranslated")) + ", count_if(runaway > 0) AS n_runaway FROM qe GROUP BY system, lang)"


@_query(f"WITH {_PAIR}, {_SEG} SELECT * FROM qe")
def qe_segment(t):
    return _segments(t)


@_query(f"WITH {_PAIR}, {_SEG}, {_LANG} SELECT * FROM by_lang")
def qe_lang_aggregate(t):
    return _by_lang(t)


@_query(f"WITH {_PAIR}, {_SEG}, {_LANG} SELECT system, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(quality) / count(*)) AS BIGINT) AS quality FROM by_lang GROUP BY system")
def qe_system_macro(t):
    """Means over the languages' floored means."""
    return _by_lang(t).groupBy("system").agg(F.sum("n").alias("n"), F.floor(F.sum("quality") / F.count(F.lit(1))).cast("long").alias("quality"))


@_query(f"WITH {_PAIR}, {_SEG}, {_LANG} SELECT lang, max(CASE WHEN system = 'forward' THEN quality END) AS forward, max(CASE WHEN system = 'backward' THEN quality END) AS backward, CASE WHEN max(CASE WHEN system = 'forward' THEN quality END) >= max(CASE WHEN system = 'backward' THEN quality END) THEN 'forward' ELSE 'backward' END AS best FROM by_lang GROUP BY lang")
def qe_best_system(t):
    p = _by_lang(t).groupBy("lang").pivot("system", ["forward", "backward"]).agg(F.max("quality"))
    return p.withColumn("best", F.when(F.col("forward") >= F.col("backward"), "forward").otherwise("backward"))


_REPEAT = "rep AS (SELECT id, min(pos) + 2 AS repeat_at FROM (SELECT id, pos, row_number() OVER (PARTITION BY id, gram ORDER BY pos) AS k FROM (SELECT id, unnest(range(greatest(len(t) - 2, 0))) AS pos, unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i : i + 2], chr(1)))) AS gram FROM tk)) WHERE k = 2 GROUP BY id)"
_FIX = f"{_REPEAT}, fx AS (SELECT id, text, t, least(coalesce(repeat_at, 2147483647), CAST(floor(least(64.0, greatest(len(t) * 2.0, len(t) + 8))) AS BIGINT)) AS stop FROM tk LEFT JOIN rep USING (id)), fixed AS (SELECT id, stop < len(t) AS changed, CASE WHEN stop < len(t) THEN array_to_string(t[1 : stop], ' ') ELSE text END AS fixed FROM fx)"
_TURNS = f"tk AS (SELECT conv_id * 1048576 + turn AS id, text, {_indic('text')} AS t FROM conversations)"


def _turns(t) -> DataFrame:
    return t("conversations").select((F.col("conv_id") * 1048576 + F.col("turn")).alias("id"), "text")


@_query(f"WITH {_TURNS}, {_REPEAT} SELECT id, repeat_at FROM rep")
def first_repeat_ngram(t):
    return evaluation.first_repeat(_turns(t).withColumn("t", T.indic_tokens(F.col("text"))), "id", "t")


@_query(f"WITH {_TURNS}, {_FIX} SELECT id, changed, md5(fixed) AS fixed_md5 FROM fixed")
def decode_fix(t):
    return evaluation.decode_fix(_turns(t), "text").select("id", "changed", F.md5("fixed").alias("fixed_md5"))


@_query(f"WITH {_TURNS}, {_FIX} SELECT count(*) AS n, count_if(changed) AS n_changed FROM fixed")
def decode_fix_changed(t):
    return evaluation.decode_fix(_turns(t), "text").agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("n_changed"))


@_query(f"WITH {_TURNS} SELECT id, md5(CASE WHEN len(list_filter(range(1, len(t) + 1), lambda i: i = 1 OR t[i] <> t[i - 1])) < len(t) THEN array_to_string(list_transform(list_filter(range(1, len(t) + 1), lambda i: i = 1 OR t[i] <> t[i - 1]), lambda i: t[i]), ' ') ELSE text END) AS collapsed_md5 FROM tk")
def decode_fix_collapse(t):
    return evaluation.collapse_fix(_turns(t), "text").select("id", F.md5("collapsed").alias("collapsed_md5"))


_SHORT = f"short AS (SELECT pair_id AS id, len({_indic('english')}) <= len({_indic('target')}) AS from_first, CASE WHEN len({_indic('english')}) <= len({_indic('target')}) THEN english ELSE target END AS text FROM pair)"


def _shorter(t) -> DataFrame:
    p = _pairs(t)
    return evaluation.take_shorter(p.select("pair_id", F.col("english").alias("text")), p.select("pair_id", F.col("target").alias("text")), "pair_id", "text")


@_query(f"WITH {_PAIR}, {_SHORT} SELECT id AS pair_id, from_first, md5(text) AS chosen_md5 FROM short")
def take_shorter(t):
    return _shorter(t).select("pair_id", "from_first", F.md5("chosen").alias("chosen_md5"))


@_query(f"WITH {_PAIR}, {_SHORT}, tk AS (SELECT id, text, {_indic('text')} AS t FROM short), {_FIX} SELECT id AS pair_id, changed, md5(fixed) AS fixed_md5 FROM fixed")
def take_shorter_fixed(t):
    return evaluation.decode_fix(_shorter(t), "chosen").select("pair_id", "changed", F.md5("fixed").alias("fixed_md5"))


def _stats_sql(hyp: str, ref: str, orders: range, grams, source: str = "pair", by: str = "", tag: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT {by}pair_id, {n} AS n, {side} AS side, unnest({grams(col, n)}) AS gram FROM tok{tag}" for n in orders for side, col in ((0, "h"), (1, "r")))
    return f"tok{tag} AS (SELECT {by}pair_id, {hyp} AS h, {ref} AS r FROM {source}), gr{tag} AS ({parts}), ct{tag} AS (SELECT {by}pair_id, n, gram, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r FROM gr{tag} GROUP BY {by}pair_id, n, gram), stats{tag} AS (SELECT {by}n, CAST(sum(least(h, r)) AS BIGINT) AS matches, CAST(sum(h) AS BIGINT) AS hyp_total, CAST(sum(r) AS BIGINT) AS ref_total FROM ct{tag} GROUP BY {by}n)"


_BLEU = _stats_sql(_13a("target"), _13a("english"), range(1, 5), lambda c, n: _grams(c, n))
_CHARS = lambda c, n: f"list_transform(range(1, greatest(length({c}) - {n} + 2, 1)), lambda i: substr({c}, i, {n}))"
_MARK = "[!-/:-@\\[-`{-~]"


def _apart(x: str) -> str:
    words = f"list_filter(string_split_regex({x}, '{_SPACE}'), lambda w: w <> '')"
    return f"flatten(list_transform({words}, lambda w: CASE WHEN length(w) = 1 THEN [w] WHEN regexp_matches(w[-1], '{_MARK}') THEN [w[:-2], w[-1]] WHEN regexp_matches(w[1], '{_MARK}') THEN [w[1], w[2:]] ELSE [w] END))"


def _chr_grams(c: str, n: int) -> str:
    of = lambda x: _CHARS(x, n) if n <= 6 else _grams("w" + x, str(n - 6))
    return of("r") if c == "r" else f"CASE WHEN len({of('r')}) > 0 THEN {of('h')} ELSE [] END"


def _chrf_sql(hyp: str, ref: str, words: int = 0, **more) -> str:
    bare = lambda x: f"regexp_replace({x}, '{_SPACE}', '', 'g')"
    return _stats_sql(bare(hyp), f"{bare(ref)} AS r, {_apart(hyp)} AS wh, {_apart(ref)} AS wr", range(1, 7 + words), _chr_grams, **more).replace("AS wr AS r", "AS wr")


_CHRF = _chrf_sql("target", "english")
_CHRF_FORM = "CASE WHEN p + r > 0 THEN CAST(floor(1000000 * (1 + 4.0) * p * r / (4.0 * p + r) + 0.5) AS BIGINT) ELSE 0 END AS chrf_e4"
_CHRF_MEAN = "avg(matches / hyp_total) FILTER (hyp_total > 0 AND ref_total > 0) AS p, avg(matches / ref_total) FILTER (hyp_total > 0 AND ref_total > 0) AS r"


def _bleu_stats(t, hyp: str = "target", ref: str = "english", tokens=T.tokens_13a) -> DataFrame:
    p = _pairs(t).select(tokens(F.col(hyp)).alias("h"), tokens(F.col(ref)).alias("r"))
    return evaluation.clipped_matches(p, [("h", "r", 4)])


@_query(f"WITH {_PAIR}, {_BLEU} SELECT * FROM stats")
def bleu13a_stats(t):
    return _bleu_stats(t)


_BLEU_FORM = "SELECT CASE WHEN count_if(matches > 0) = 4 THEN CAST(floor(1000000 * CASE WHEN max(hyp_total) FILTER (n = 1) > max(ref_total) FILTER (n = 1) THEN 1.0 ELSE exp(1.0 - max(ref_total) FILTER (n = 1) / max(hyp_total) FILTER (n = 1)) END * exp(sum(ln(matches / hyp_total)) FILTER (matches > 0) / 4) + 0.5) AS BIGINT) ELSE 0 END AS bleu_e4, max(hyp_total) FILTER (n = 1) AS hyp_len, max(ref_total) FILTER (n = 1) AS ref_len FROM stats"


@_query(f"WITH {_PAIR}, {_BLEU} {_BLEU_FORM}")
def bleu_corpus(t):
    return evaluation.bleu(_bleu_stats(t))


@_query(f"WITH {_PAIR}, {_stats_sql(f'list_transform({_indic("target")}, lambda x: lower(x))', f'list_transform({_indic("english")}, lambda x: lower(x))', range(1, 5), lambda c, n: _grams(c, n))} {_BLEU_FORM}")
def bleu_indic_corpus(t):
    return evaluation.bleu(_bleu_stats(t, tokens=lambda c: F.transform(T.indic_tokens(c), F.lower)))


@_query(f"WITH {_PAIR}, {_CHRF} SELECT * FROM stats")
def chrf_stats(t):
    return evaluation.chrf_stats(_pairs(t), "target", "english")


@_query(f"WITH {_PAIR}, {_CHRF} SELECT {_CHRF_FORM} FROM (SELECT {_CHRF_MEAN} FROM stats)")
def chrf_corpus(t):
    return evaluation.chrf(evaluation.chrf_stats(_pairs(t), "target", "english"))


@_query(f"WITH {_PAIR}, {_chrf_sql('target', 'english', 2)} SELECT {_CHRF_FORM} FROM (SELECT {_CHRF_MEAN} FROM stats)")
def chrf_words_corpus(t):
    """With word orders 1 and 2 beside the characters'."""
    return evaluation.chrf(evaluation.chrf_stats(_pairs(t), "target", "english", 2))


@_query(f"WITH {_PAIR}, {_BLEU} SELECT n, CAST(floor(10000 * matches / hyp_total + 0.5) AS BIGINT) AS precision_e4, CAST(floor(10000 * CASE WHEN c > r THEN 1.0 ELSE exp(1.0 - r / c) END + 0.5) AS BIGINT) AS bp_e4, CAST(floor(10000 * c / r + 0.5) AS BIGINT) AS len_ratio_e4 FROM stats, (SELECT hyp_total AS c, ref_total AS r FROM stats WHERE n = 1)")
def bleu_report(t):
    return evaluation.bleu_parts(_bleu_stats(t))


_METHODS = f"tk AS (SELECT pair_id AS id, target AS text, {_indic('target')} AS t FROM pair), {_FIX}, method AS (SELECT 'before' AS method, pair_id, target AS hyp, english AS ref FROM pair UNION ALL SELECT 'after', id, fixed, english FROM fixed JOIN pair ON id = pair_id)"
_SCORES = f"{_METHODS}, {_stats_sql(_13a('hyp'), _13a('ref'), range(1, 5), lambda c, n: _grams(c, n), source='method', by='method, ')}, {_chrf_sql('hyp', 'ref', 2, source='method', by='method, ', tag='2')}, score AS (SELECT * FROM ({_BLEU_FORM.replace('SELECT', 'SELECT method,', 1)} GROUP BY method) JOIN (SELECT method, {_CHRF_FORM} FROM (SELECT method, {_CHRF_MEAN} FROM stats2 GROUP BY method)) USING (method))"


def _method_scores(t) -> DataFrame:
    p = _pairs(t)
    fixed = evaluation.decode_fix(p, "target")
    both = p.select(F.lit("before").alias("method"), "pair_id", F.col("target").alias("hyp"), F.col("english").alias("ref"))
    both = both.union(fixed.select(F.lit("after"), "pair_id", "fixed", "english"))
    tokens = both.select("method", "pair_id", T.tokens_13a(F.col("hyp")).alias("h"), T.tokens_13a(F.col("ref")).alias("r"))
    words = evaluation.clipped_matches(tokens, [("h", "r", 4)], ("method",))
    chars = evaluation.chrf_stats(both, "hyp", "ref", 2, ("method",))
    return evaluation.bleu(words, ("method",)).join(evaluation.chrf(chars, by=("method",)), "method")


@_query(f"WITH {_PAIR}, {_SCORES} SELECT method, bleu_e4, hyp_len, ref_len, chrf_e4 FROM score")
def method_scores(t):
    """All methods' scores from one token table: output as it is, and repaired."""
    return _method_scores(t)


@_query(f"WITH {_PAIR}, {_SCORES} SELECT " + ", ".join(f"b.{c} AS {c}_before, a.{c} AS {c}_after, a.{c} - b.{c} AS {c}_delta" for c in ("bleu_e4", "hyp_len", "chrf_e4")) + " FROM score a, score b WHERE a.method = 'after' AND b.method = 'before'")
def method_deltas(t):
    return reports.deltas(_method_scores(t), "method", "before", "after", ["bleu_e4", "hyp_len", "chrf_e4"])


def _diagonals(h: str, r: str, edge: str, best: str) -> str:
    """d AS (pair_id, n, m, v): a measure of token lists whose table of n + 1 by m + 1 cells is filled one diagonal k a step.

    List q is the diagonal before p; cell i of p is row i - 1.  edge is the value
    of a cell in the first row or column, best of the others, from up and left in
    p, the corner in q, and same (1 for equal tokens).
    """
    cell = best.format(up="p[i]", left="p[i + 1]", corner="q[i]", same="CAST(h[i] = r[k + 1 - i] AS INTEGER)")
    step = f"CASE WHEN i > k + 1 OR k + 1 - i > m THEN NULL WHEN i = 0 OR i = k + 1 THEN {edge} ELSE {cell} END"
    return f"""seg AS (SELECT pair_id, h, r, len(h) AS n, len(r) AS m FROM (SELECT pair_id, {h} AS h, {r} AS r FROM pair)),
dp AS (SELECT pair_id, 0 AS k, CAST([] AS BIGINT[]) AS q, [CAST(0 AS BIGINT)] AS p FROM seg UNION ALL SELECT pair_id, CAST(k + 1 AS INTEGER), p, list_transform(range(0, n + 1), lambda i: CAST({step} AS BIGINT)) FROM dp JOIN seg USING (pair_id) WHERE k < n + m),
d AS (SELECT pair_id, n, m, p[n + 1] AS v FROM dp JOIN seg USING (pair_id) WHERE k = n + m)"""


def _rouge_sql(tokens) -> str:
    share = lambda n, d: f"CAST(round(10000 * avg(CASE WHEN v > 0 THEN {n} / ({d}) ELSE 0.0 END)) AS BIGINT)"
    lcs = _diagonals(tokens("target"), tokens("english"), "0", "greatest({up}, {left}, {corner} + {same})")
    return f"WITH RECURSIVE {_PAIR}, {lcs} SELECT count(*) AS n, {share('v', 'n')} AS rouge_l_p_e4, {share('v', 'm')} AS rouge_l_r_e4, {share('2 * v', 'n + m')} AS rouge_l_e4 FROM d"


def _rouge(t, tokens) -> DataFrame:
    p = _pairs(t).select("pair_id", tokens(F.col("target")).alias("h"), tokens(F.col("english")).alias("r"))
    p = p.withColumn("l", evaluation.pair_measure(evaluation.lcs, "long")("h", "r"))
    some = F.col("l") > 0
    share = lambda n, d: F.when(some, n / d).otherwise(0.0)
    return p.select("pair_id", share(F.col("l"), F.size("h")).alias("precision"), share(F.col("l"), F.size("r")).alias("recall"), share(2 * F.col("l"), F.size("h") + F.size("r")).alias("f"))


def _rouge_means(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("n"), *[F.round(10000 * F.avg(c)).cast("long").alias(a) for c, a in (("precision", "rouge_l_p_e4"), ("recall", "rouge_l_r_e4"), ("f", "rouge_l_e4"))])


@_query(_rouge_sql(_indic))
def rouge_l(t):
    """Corpus means of sentence ROUGE-L in 1/10000."""
    return _rouge_means(_rouge(t, T.indic_tokens))


@_query(_rouge_sql(lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"))
def rouge_l_ascii(t):
    """The same over a-z and 0-9 only."""
    return _rouge_means(_rouge(t, T.ascii_words))


@_query()
def rouge_l_bootstrap(t):
    """Medians over 1000 resamples."""
    return evaluation.bootstrap_median(_rouge(t, T.indic_tokens), "pair_id", ["precision", "recall", "f"])


def _ter(t, measure) -> DataFrame:
    p = _pairs(t).select(F.split(T.sanitize(F.lower("target")), " ").alias("h"), F.split(T.sanitize(F.lower("english")), " ").alias("r"))
    p = p.withColumn("e", evaluation.pair_measure(measure, "long")("h", "r"))
    return p.agg(F.sum("e").alias("edits"), F.sum(F.size("r")).alias("ref_words"))


@_query(f"WITH RECURSIVE {_PAIR}, {_diagonals(*[f"string_split({_clean(f'lower({x})')}, ' ')" for x in ('target', 'english')], 'k + 1', 'least({up} + 1, {left} + 1, {corner} + 1 - {same})')} SELECT CAST(sum(v) AS BIGINT) AS edits, CAST(sum(m) AS BIGINT) AS ref_words FROM d")
def ter_noshift(t):
    """Word edits over reference words."""
    return _ter(t, evaluation.edits)


@_query()
def ter_full(t):
    """Word edits and block moves over reference words."""
    return _ter(t, evaluation.shifted_edits)


_METEOR = f"""w AS (SELECT pair_id, {_indic('target')} AS h, {_indic('english')} AS r FROM pair),
o AS (SELECT pair_id, side, i, word, row_number() OVER (PARTITION BY pair_id, side, word ORDER BY i DESC) AS nth FROM (SELECT pair_id, 0 AS side, unnest(range(len(h))) AS i, lower(unnest(h)) AS word FROM w UNION ALL SELECT pair_id, 1, unnest(range(len(r))), lower(unnest(r)) FROM w)),
a AS (SELECT pair_id, x.i, y.i AS j, lag(x.i) OVER b AS before_i, lag(y.i) OVER b AS before_j FROM o x JOIN o y USING (pair_id, word, nth) WHERE x.side = 0 AND y.side = 1 WINDOW b AS (PARTITION BY pair_id ORDER BY x.i)),
c AS (SELECT pair_id, count(*) AS k, count_if(before_i IS NULL OR before_i + 1 <> i OR before_j + 1 <> j) AS chunks FROM a GROUP BY pair_id),
s AS (SELECT k / len(h) AS p, k / len(r) AS q, chunks / k AS f FROM w LEFT JOIN c USING (pair_id))"""


@_query(f"WITH {_PAIR}, {_METEOR} SELECT count(*) AS n, CAST(round(10000 * avg(CASE WHEN p IS NULL THEN 0.0 ELSE p * q / (CAST(0.9 AS DOUBLE) * p + (1 - CAST(0.9 AS DOUBLE)) * q) * (1 - CAST(0.5 AS DOUBLE) * f ** 3) END)) AS BIGINT) AS meteor_e4 FROM s")
def meteor_exact(t):
    p = _pairs(t).select(T.indic_tokens(F.col("target")).alias("h"), T.indic_tokens(F.col("english")).alias("r"))
    p = p.withColumn("m", evaluation.pair_measure(evaluation.meteor, "double")("h", "r"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.round(10000 * F.avg("m")).cast("long").alias("meteor_e4"))


_GRID = "g AS (SELECT task, lr, lr_index, eval_loss, train_loss, coalesce(eval_epoch, train_epoch) AS epoch, eval_loss IS NOT NULL AS has_eval, train_loss IS NOT NULL AS has_train FROM (SELECT DISTINCT o_orderpriority AS task FROM orders) CROSS JOIN (VALUES ('F', 0), ('O', 1), ('P', 2), ('X', 3)) l(lr, lr_index) LEFT JOIN (SELECT o_orderpriority AS task, o_orderstatus AS lr, CAST(max(o_custkey) AS DOUBLE) AS eval_loss, CAST(count(*) AS DOUBLE) AS eval_epoch FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) USING (task, lr) LEFT JOIN (SELECT o_orderpriority AS task, o_orderstatus AS lr, CAST(min(o_orderkey) AS DOUBLE) AS train_loss, CAST(max(o_orderkey) AS DOUBLE) AS train_epoch FROM orders GROUP BY ALL) USING (task, lr))"


def _grid(t) -> DataFrame:
    o = t("orders").withColumnsRenamed({"o_orderpriority": "task", "o_orderstatus": "lr"})
    rates = o.sparkSession.createDataFrame([("F", 0), ("O", 1), ("P", 2), ("X", 3)], "lr string, lr_index int")
    evals = o.where("lr <> 'P'").groupBy("task", "lr").agg(F.max("o_custkey").cast("double").alias("eval_loss"), F.count(F.lit(1)).cast("double").alias("eval_epoch"))
    trains = o.groupBy("task", "lr").agg(F.min("o_orderkey").cast("double").alias("train_loss"), F.max("o_orderkey").cast("double").alias("train_epoch"))
    return prefs.sweep_grid(o.select("task").distinct(), rates, evals, trains)


@_query(f"WITH {_GRID} SELECT task, lr, CAST(lr_index AS INTEGER) AS lr_index, eval_loss, train_loss, epoch, has_eval, has_train FROM g")
def lr_grid_join(t):
    return _grid(t)


@_query(f"WITH {_GRID} SELECT task, arg_min(lr, {{'loss': eval_loss, 'i': lr_index}}) FILTER (eval_loss IS NOT NULL) AS lr, CASE WHEN count(eval_loss) > 0 THEN 'eval_loss' END AS metric_used FROM g GROUP BY task")
def lr_best(t):
    return prefs.best_rate(_grid(t))


@_query(f"WITH {_GRID} SELECT task, coalesce(arg_min(lr, {{'loss': eval_loss, 'i': lr_index}}) FILTER (eval_loss IS NOT NULL), arg_min(lr, {{'loss': train_loss, 'i': lr_index}}) FILTER (train_loss IS NOT NULL)) AS lr, CASE WHEN count(eval_loss) > 0 THEN 'eval_loss' WHEN count(train_loss) > 0 THEN 'train_loss' END AS metric_used FROM g GROUP BY task")
def lr_best_fallback(t):
    return prefs.best_rate(_grid(t), fallback=True)


def _nodes(t) -> DataFrame:
    return t("conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("node"))


@_query("SELECT conv_id, turn, CASE WHEN role <> 'system' THEN 'gpt' END AS sender, CASE WHEN role <> 'system' THEN md5(text) END AS value_md5 FROM conversations")
def role_rewrite(t):
    return _nodes(t).select("conv_id", "turn", prefs.rewrite_role("node").alias("n")).select("conv_id", "turn", F.col("n.from").alias("sender"), F.md5("n.value").alias("value_md5"))


@_query("SELECT CASE WHEN role <> 'system' THEN role END AS old_role, CASE WHEN role = 'system' THEN 'missing' WHEN role = 'gpt' THEN 'ok' ELSE 'fixed' END AS state, count(*) AS n FROM conversations GROUP BY ALL")
def role_histogram(t):
    return prefs.role_counts(_nodes(t), "node")


@_query(f"WITH {_PAIR} SELECT pair_id, 'human' AS asks, md5(english) AS prompt_md5, 'gpt' AS answers, md5(target) AS chosen_md5, md5(target || ' ' || english) AS rejected_md5 FROM pair")
def dpo_assemble(t):
    r = _pairs(t).select("pair_id", *prefs.preference(F.col("english"), F.col("target"), F.concat_ws(" ", "target", "english")))
    first = F.col("conversations")[0]
    return r.select("pair_id", first["from"].alias("asks"), F.md5(first["value"]).alias("prompt_md5"), F.col("chosen.from").alias("answers"), F.md5("chosen.value").alias("chosen_md5"), F.md5("rejected.value").alias("rejected_md5"))


@_query(f"SELECT doc_id AS id, md5({_clean('text')}) AS line_md5 FROM documents")
def submission_lines(t):
    return submission.lines(t("documents"), "doc_id", "text").select("id", F.md5("line").alias("line_md5"))


@_query(f"WITH {_PAIR} SELECT pair_id AS id, coalesce({_clean('english')} = {_clean('c.text')}, false) AS ok FROM pair LEFT JOIN conversations c ON pair_id = c.conv_id * 1048576 + c.turn + 1")
def verify_source_alignment(t):
    """Every pair's sentence against the turn after it: all differ unless a turn repeats."""
    official = t("conversations").select((F.col("conv_id") * 1048576 + F.col("turn") + 1).alias("id"), F.col("text").alias("source"))
    return submission.verify_sources(_pairs(t).select(F.col("pair_id").alias("id"), F.col("english").alias("source")), official)


@_query("SELECT doc_id AS line_no, contains(text, chr(13)) AS has_cr, text = trim(regexp_replace(text, '" + _SPACE + "', ' ', 'g')) AS ok FROM documents")
def verify_txt_integrity(t):
    d = t("documents")
    return submission.verify_lines(d.select(F.col("doc_id").alias("line_no"), F.col("text").alias("line")), submission.lines(d, "doc_id", "text")).select("line_no", "has_cr", "ok")


@_query("SELECT conv_id * 1048576 + turn AS id, md5(text || '.') AS output_md5, CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 2 END AS attempts, 'ok' AS status FROM conversations")
def generator_retry(t):
    """A stub model that answers texts of odd length at the second attempt only."""

    def model(prompts: list[str], attempt: int) -> list[str]:
        return [p + "." if attempt or len(p) % 2 == 0 else "" for p in prompts]

    got = generation.generate(_turns(t), "id", "text", model)
    return got.select("id", F.md5("output").alias("output_md5"), F.col("attempts").cast("int").alias("attempts"), "status")


@_query("SELECT conv_id * 1048576 + turn AS id, md5(text || '!') AS rejected_md5, length(text) % 3 + 1 AS attempts FROM conversations")
def rejected_sampling(t):
    """A stub model that repeats the chosen text until its attempt reaches the text's length modulo 3."""

    def model(prompts: list[str], attempt: int) -> list[str]:
        return [p + "!" if attempt >= len(p) % 3 else p for p in prompts]

    turns = _turns(t).withColumn("text", T.trim_space(F.col("text")))
    return generation.rejected(turns, "id", "text", "text", model).select("id", F.md5("output").alias("rejected_md5"), F.col("attempts").cast("int").alias("attempts"))


@_query("SELECT count(*) AS n, count_if(length(text) % 2 = 0) AS n_ok, count_if(length(text) % 2 <> 0) AS n_failed FROM conversations")
def run_counters(t):
    """One attempt, in which the stub answers texts of even length only."""
    got = generation.generate(_turns(t), "id", "text", lambda prompts, attempt: [p if len(p) % 2 == 0 else "" for p in prompts], tries=1)
    return reports.counters(got)


_ASKED = """sm AS (SELECT word, t, pair_id, row_number() OVER (PARTITION BY word, t ORDER BY CASE WHEN t < 8 THEN md5('recover-' || CAST(t AS VARCHAR) || '-' || word || '|' || CAST(pair_id AS VARCHAR)) END, pair_id) AS r FROM post, range(9) s(t)),
sp AS (SELECT word, t, CASE WHEN t = 8 THEN r ELSE 0 END AS place, pair_id, english, target, row_number() OVER (PARTITION BY word, t, CASE WHEN t = 8 THEN r ELSE 0 END ORDER BY pair_id) AS line FROM sm JOIN pair USING (pair_id) WHERE r <= 10),
st AS (SELECT word, t, place, list(pair_id ORDER BY pair_id) AS ids, string_agg(CAST(line AS VARCHAR) || '. EN: ' || english || chr(10) || '   Target: ' || target, chr(10) ORDER BY line) AS lines FROM sp GROUP BY word, t, place),
one AS (SELECT * FROM st QUALIFY t = 8 OR row_number() OVER (PARTITION BY word, ids, t = 8 ORDER BY t) = 1),
told AS (SELECT word, t, place, length('Which Target words translate "' || word || '" in these sentences?' || chr(10) || lines || chr(10) || 'Answer with JSON: {"word": "' || word || '", "candidates": [{"target": "...", "probability": 0.0}]}') % 7 AS n FROM one),
fin AS (SELECT word, min(t) AS t FROM told WHERE n > 4 GROUP BY word), made AS (SELECT told.* FROM told LEFT JOIN fin USING (word) WHERE fin.t IS NULL OR told.t <= fin.t)"""


@_query(f"WITH {_PAIR}, {_DICT}, {_POST}, {_ASKED}, c AS (SELECT word, count(*) AS total_pairs FROM post GROUP BY word) SELECT word, least(total_pairs, 10) AS samples_used, total_pairs, CAST(count_if(n > 4) > 0 AS BIGINT) AS n_candidates, CASE WHEN count_if(n > 4) > 0 THEN max(n) * 1000 ELSE 0 END AS best_e4, count_if(n > 4) AS n_ok, count_if(n < 4) AS n_blocked, count_if(n = 4) AS n_failed FROM c JOIN made USING (word) GROUP BY word, total_pairs")
def recover_words(t):
    """Words whose prompts a stub service blocks by length are asked again with other samples, then pair by pair."""

    def send(prompt: str) -> tuple[str, str]:
        n = len(prompt) % 7
        word = prompt.split('"')[1]
        return ("blocked", "") if n < 4 else ("neterr", "") if n == 4 else ("ok", '{"candidates": [{"target": "' + word + '", "probability": 0.' + str(n) + "}]}")

    got = generation.recover_words(_index(t), _pairs(t), send, "Target")
    best = F.coalesce(F.round(10000 * F.try_element_at("candidates", F.lit(1))["probability"]), F.lit(0)).cast("long")
    return got.select("word", "samples_used", "total_pairs", F.size("candidates").cast("long").alias("n_candidates"), best.alias("best_e4"), "n_ok", "n_blocked", "n_failed")


@_query("SELECT conv_id, turn, md5(CASE WHEN role = 'user' THEN text WHEN role = 'assistant' THEN role ELSE CAST(conv_id AS VARCHAR) END) AS prompt_md5 FROM conversations")
def chat_prompt(t):
    c = t("conversations").withColumns({"instruction": F.when(F.col("role") == "user", F.col("text")), "input": F.when(F.col("role") == "assistant", F.col("role"))})
    return c.select("conv_id", "turn", F.md5(generation.chat_prompt("instruction", "input", record="conv_id")).alias("prompt_md5"))


@_query(f"""WITH {_PAIR}, {_DICT}, {_POST}, {_LEX}, w AS (SELECT pair_id, word, min(i) AS i FROM (SELECT pair_id, unnest({_strip('english')}) AS word, unnest(range(len({_strip('english')}))) AS i FROM pair) GROUP BY ALL),
o AS (SELECT pair_id, word, row_number() OVER (PARTITION BY pair_id ORDER BY i) - 1 AS pos FROM w) SELECT pair_id, CAST(pos AS INTEGER) AS pos, word, target, p_bp FROM o JOIN top USING (word)""")
def vocab_lookup_ordered(t):
    """Candidates of a sentence's words, with their places in the sentence."""
    return corpus.vocabulary_of(_pairs(t), corpus.top_candidates(_lexicon(t))).select("pair_id", "pos", "word", "target", "p_bp")


@_query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_wins(t):
    """Of repeated ids the last counts."""
    return corpus.last_of(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@_query("SELECT place, o_orderkey, c_custkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS place, o_orderkey FROM orders) JOIN (SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_custkey FROM customer) USING (place)")
def positional_zip(t):
    return corpus.zipped(t("orders").select("o_orderkey"), "o_orderkey", t("customer").select("c_custkey"), "c_custkey").select("place", "o_orderkey", "c_custkey")


@_query("""WITH b AS (SELECT n_name AS system, CAST(floor(avg(CAST(floor(c_acctbal) AS BIGINT))) AS BIGINT) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), u AS (SELECT system, score, false AS ours FROM b UNION ALL SELECT 'ours', CAST(floor(avg(CAST(floor(s_acctbal) AS BIGINT))) AS BIGINT), true FROM supplier)
SELECT system, score, ours, CAST(row_number() OVER (ORDER BY score DESC, ours DESC, system) AS INTEGER) AS rank, score - (SELECT max(score) FROM b) AS gap FROM u""")
def leaderboard(t):
    """Nations as published systems by their customers' balances, the suppliers as ours."""
    whole = lambda c: F.floor(F.avg(F.floor(c))).cast("long").alias("score")
    published = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("system")).agg(whole("c_acctbal"))
    return reports.leaderboard(t("supplier").agg(whole("s_acctbal")).withColumn("system", F.lit("ours")), published, "system", "score")


@_query(f"SELECT lang, source, count(*) AS n, count_if(text <> {_clean('text')}) AS n_bad, count_if(text <> {_clean('text')}) = 0 AS ok FROM documents GROUP BY GROUPING SETS ((lang, source), ())")
def verify_rollup(t):
    """Lines that are written as they are, by language and source and over all."""
    return reports.all_ok(t("documents").withColumn("ok", F.col("text") == T.sanitize(F.col("text"))), "ok", "lang", "source")


@_query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN printf('%.2f', c_nationkey / 4) ELSE '-' END AS shown FROM customer")
def number_format(t):
    return t("customer").select("c_custkey", reports.shown(F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey") / 4)).alias("shown"))


@_query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'target' WHEN contains(lower(p_type), 'en') OR contains(lower(p_type), 'source') THEN 'source' WHEN p_size % 3 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'target' END END AS role FROM part")
def column_role_guess(t):
    return t("part").select("p_partkey", parallel.column_role(F.col("p_type"), F.col("p_partkey") % 2, F.col("p_size") % 3, ["Steel"]).alias("role"))


@_query(f"WITH {_PLAN} SELECT slot, lang, 'team_' || slot || '_' || pair || '.txt' AS name FROM slot, lang")
def submission_names(t):
    return submission.plan(t("nation").sparkSession).select("slot", "lang", parallel.submission_name("team", F.col("slot"), F.col("pair")).alias("name"))


_ASCII = lambda c: f"sum(length(regexp_replace({c}, '[^\\x00-\\x7f]', '', 'g'))) FILTER (row_no <= 30) / sum(length({c})) FILTER (row_no <= 30)"
_TRIM = lambda c: f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


@_query(f"""WITH {_PAIR}, r AS (SELECT CAST(turn % 4 AS VARCHAR) AS path, row_number() OVER (PARTITION BY turn % 4 ORDER BY pair_id) AS row_no, CASE WHEN turn % 4 < 2 THEN target ELSE english END AS a, CASE WHEN turn % 4 < 2 THEN english ELSE target END AS b FROM pair),
v AS (SELECT path, {_ASCII('a')} >= {_ASCII('b')} AS f FROM r GROUP BY path) SELECT path, row_no, md5({_TRIM('CASE WHEN f THEN a ELSE b END')}) AS english_md5, md5({_TRIM('CASE WHEN f THEN b ELSE a END')}) AS target_md5 FROM r JOIN v USING (path)""")
def sheet_pairs(t):
    """Sheets without header, the English column by vote of each sheet's first rows."""
    swap = F.col("turn") % 4 < 2
    cells = F.create_map(F.lit(0), F.when(swap, F.col("target")).otherwise(F.col("english")), F.lit(1), F.when(swap, F.col("english")).otherwise(F.col("target")))
    number = F.row_number().over(corpus.Window.partitionBy(F.col("turn") % 4).orderBy("pair_id")).cast("long")
    rows = _pairs(t).select((F.col("turn") % 4).cast("string").alias("path"), number.alias("row_no"), cells.alias("cells"))
    got = parallel.sheet_pairs(rows, "exact")
    return got.select("path", "row_no", F.md5("english").alias("english_md5"), F.md5("target").alias("target_md5"))


@_query(f"WITH {_PAIR}, r AS (SELECT 's' || CAST(turn % 4 AS VARCHAR) || '.xlsx' AS name, row_number() OVER (PARTITION BY turn % 4 ORDER BY pair_id) + 1 AS row_no, english, target FROM pair) SELECT name, row_no, md5({_TRIM('english')}) AS english_md5, md5({_TRIM('target')}) AS target_md5 FROM r WHERE {_TRIM('english')} <> '' AND {_TRIM('target')} <> ''")
def xlsx_roundtrip(t):
    """Workbooks with a header, written and read again, the English column second."""
    number = F.row_number().over(corpus.Window.partitionBy(F.col("turn") % 4).orderBy("pair_id")).cast("long")
    rows = _pairs(t).select(F.concat(F.lit("s"), (F.col("turn") % 4).cast("string"), F.lit(".xlsx")).alias("name"), number.alias("row_no"), F.array("target", "english").alias("cells"))
    heads = rows.select("name").distinct().select("name", F.lit(0).cast("long").alias("row_no"), F.array(F.lit("Target"), F.lit("English")).alias("cells"))
    folder = working.folder(rows.sparkSession)
    xlsx.write_sheets(rows.union(heads), folder).collect()  # a row a workbook
    got = parallel.sheet_pairs(parallel.sheet_rows(rows.sparkSession, folder), "exact")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("name"), "row_no", F.md5("english").alias("english_md5"), F.md5("target").alias("target_md5"))


@_query(f"SELECT conv_id, turn, md5({_TRIM('text')}) AS predict_md5, CASE WHEN role = 'user' THEN '' ELSE role END AS label FROM conversations")
def json_poly_scan(t):
    """Records with differing field names, written as JSON lines and read again; an absent label is empty."""
    c = t("conversations")
    fields = [F.when(F.col("role") == r, F.col("text")).alias(n) for r, n in (("user", "tagin"), ("assistant", "prediction"), ("system", "predicted_translation"))]
    record = F.to_json(F.struct("conv_id", "turn", *fields, F.when(F.col("role") != "user", F.col("role")).alias("original_label")))
    folder = working.folder(c.sparkSession) + "/table"
    parallel.write_records(c.select((F.col("conv_id") * 1048576 + F.col("turn")).alias("row_no"), record.alias("record")), folder)
    both = records.read_records(c.sparkSession, folder).select(parallel.field("record", "conv_id").cast("long").alias("conv_id"), parallel.field("record", "turn").cast("long").alias("turn"), "path", "row_no")
    return both.join(parallel.predictions(c.sparkSession, folder), ["path", "row_no"]).select("conv_id", "turn", F.md5("predict").alias("predict_md5"), "label")


@_query("SELECT conv_id * 1048576 + turn AS id, CASE WHEN (conv_id + turn) % 2 = 0 THEN 1 ELSE 2 END AS run FROM conversations")
def resume_append(t):
    """A first run stops half-way; the second one does what is left."""
    c = t("conversations").select((F.col("conv_id") * 1048576 + F.col("turn")).alias("id"), ((F.col("conv_id") + F.col("turn")) % 2).alias("odd"))
    folder = working.folder(c.sparkSession) + "/table"
    records.run_remaining(c.where("odd = 0"), "id", folder, lambda todo: todo.select("id", F.lit(1).alias("run")))
    return records.run_remaining(c, "id", folder, lambda todo: todo.select("id", F.lit(2).alias("run")))


@_query("SELECT row_number() OVER (ORDER BY p_partkey) AS line_no, trim(regexp_replace(p_name, '" + _SPACE + "', ' ', 'g')) AS line FROM part")
def txt_roundtrip(t):
    """Ordered lines, written and read back: part files in the order of their names make up the text."""
    part = t("part")
    folder = working.folder(part.sparkSession) + "/table"
    submission.write_lines(part.withColumn("id", F.col("p_partkey") + 1), "id", "p_name", folder)
    got = parallel.text_lines(part.sparkSession, folder + "/part-*")
    # lines before each file: a row a file
    files = got.groupBy("path").agg(F.count(F.lit(1)).alias("n")).select("path", F.coalesce(F.sum("n").over(corpus.Window.orderBy("path").rowsBetween(corpus.Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return got.join(F.broadcast(files), "path").select((F.col("line_no") + F.col("before")).alias("line_no"), "line")


@_query("SELECT lang, CASE lang WHEN 'en' THEN 'base-2' WHEN 'fr' THEN 'romance' END AS model, lang NOT IN ('en', 'fr') AS skipped FROM (SELECT DISTINCT lang FROM documents)")
def model_lookup(t):
    """Languages with their model; those without one are skipped, of repeated entries the last counts."""
    d = t("documents").select("lang").distinct()
    return submission.models_for(d, d.sparkSession.createDataFrame([("en", "base", 0), ("en", "base-2", 1), ("fr", "romance", 2), ("xx", "other", 3)], "lang string, model string, place int"))


@_query(f"WITH {_PAIR}, {_SEG}, {_LANG} SELECT system, '{{' || string_agg('\"' || lang || '\":{{\"n\":' || n || ',\"quality\":' || quality || '}}', ',' ORDER BY CAST(lang AS VARCHAR)) || '}}' AS report FROM by_lang GROUP BY system".replace('\\"', '"'))
def nested_report(t):
    return reports.nested(_by_lang(t), "system", "lang", ["n", "quality"])


@_query(f"WITH {_GRID}, b AS (SELECT task, coalesce(arg_min(lr, {{'loss': eval_loss, 'i': lr_index}}) FILTER (eval_loss IS NOT NULL), arg_min(lr, {{'loss': train_loss, 'i': lr_index}}) FILTER (train_loss IS NOT NULL)) AS lr, CASE WHEN count(eval_loss) > 0 THEN 'eval_loss' WHEN count(train_loss) > 0 THEN 'train_loss' END AS metric_used FROM g GROUP BY task) SELECT count(*) AS n_tasks, count_if(metric_used = 'eval_loss') AS n_eval, count_if(metric_used = 'train_loss') AS n_train, count_if(metric_used IS NULL) AS n_none, (SELECT lr FROM b WHERE lr IS NOT NULL GROUP BY lr ORDER BY count(*) DESC, lr LIMIT 1) AS lr FROM b")
def sweep_summary(t):
    return prefs.sweep_summary(_grid(t))


@_query()
def metric_bundle(t):
    """The eight scores of output as it is and repaired: BLEU, chrF with word orders, TER, ROUGE-L of both tokenisers, METEOR, and both lengths."""
    p = _pairs(t)
    fixed = evaluation.decode_fix(p, "target")
    both = p.select(F.lit("before").alias("method"), F.col("target").alias("hyp"), F.col("english").alias("ref"))
    both = both.union(fixed.select(F.lit("after"), "fixed", "english"))
    plain = lambda c: F.split(T.sanitize(F.lower(c)), " ")
    sides = {k: [f("hyp").alias(f"h_{k}"), f("ref").alias(f"r_{k}")] for k, f in (("plain", plain), ("indic", lambda c: T.indic_tokens(F.col(c))), ("ascii", lambda c: T.ascii_words(F.col(c))))}
    seg = both.select("method", *[c for x in sides.values() for c in x])
    measured = {"edits": ("plain", evaluation.shifted_edits, "long"), "l": ("indic", evaluation.lcs, "long"), "l_ascii": ("ascii", evaluation.lcs, "long"), "meteor": ("indic", evaluation.meteor, "double")}
    seg = seg.withColumns({name: evaluation.pair_measure(f, kind)(f"h_{k}", f"r_{k}") for name, (k, f, kind) in measured.items()})
    f_of = lambda lcs, k: F.when(F.col(lcs) > 0, 2 * F.col(lcs) / (F.size(f"h_{k}") + F.size(f"r_{k}"))).otherwise(0.0)
    e4 = lambda c: F.round(10000 * c).cast("long")
    rest = seg.groupBy("method").agg(e4(F.sum("edits") / F.sum(F.size("r_plain"))).alias("ter_e4"), e4(F.avg(f_of("l", "indic"))).alias("rouge_l_e4"), e4(F.avg(f_of("l_ascii", "ascii"))).alias("rouge_l_ascii_e4"), e4(F.avg("meteor")).alias("meteor_e4"))
    return _method_scores(t).join(rest, "method")
