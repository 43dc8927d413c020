"""The toolkit's operators as registered queries over the driver's tables, each beside its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelith.functions import answers, chunks, stats
from tracelith.functions.tokens import base_types, compressed
from tracelith.operators import cards, corpus, evaluate, mining, models, resample, signals as signal, summaries, within
from tracelith.plans import export
from tracelith.sources import tables
from tracelith.sources.scratch import Scratch
from tracelith.sources.traces import event_traces, order_traces, table
from tracelith.streaming import collect, status

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T1 = """t AS (
  SELECT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS trace_id, CAST(user_id AS VARCHAR) AS question_id, strftime(ts, '%Y-%m-%d') AS sample_id,
    list(event_type ORDER BY ts, event_id) AS tokens, max(value) >= 75 AS is_correct, arg_max(event_type, ROW(value, -event_id)) AS predicted_answer
  FROM events GROUP BY ALL
)"""
T2 = """t AS (
  SELECT CAST(o_custkey AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR) AS trace_id, CAST(o_custkey AS VARCHAR) AS question_id, CAST(o_orderkey AS VARCHAR) AS sample_id, tokens, o_orderstatus = 'F' AS is_correct
  FROM (SELECT l_orderkey, list(l_returnflag || ':' || l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag || ':' || l_linestatus) AS tokens FROM lineitem GROUP BY 1)
  JOIN orders ON l_orderkey = o_orderkey
)"""
TOTALS = "n AS (SELECT count(*) FILTER (is_correct) AS s, count(*) FILTER (NOT is_correct) AS f FROM t)"
NGRAMS = """g AS (
  SELECT DISTINCT trace_id, question_id, is_correct, tokens, array_to_string(list_slice(tokens, i, i + k - 1), '|') AS motif, CAST(k AS INTEGER) AS k
  FROM t, generate_series({low}, {high}) a(k), generate_series(1, len(tokens)) b(i) WHERE i + k - 1 <= len(tokens)
)"""
#: Log factorials, exact tests and false discovery rates.
MACRO = {
    "fisher": "least(1.0, list_sum(list_filter(list_transform(generate_series(greatest(0, {r} + {k} - {n}), least({r}, {k})), lambda x: exp(lgamma({r} + 1) + lgamma({n} - {r} + 1) + lgamma({k} + 1) + lgamma({n} - {k} + 1) - lgamma({n} + 1) - lgamma(x + 1) - lgamma({r} - x + 1) - lgamma({k} - x + 1) - lgamma({n} - {r} - {k} + x + 1))), lambda q: q <= {most})))",
    "own": "exp(lgamma({r} + 1) + lgamma({n} - {r} + 1) + lgamma({k} + 1) + lgamma({n} - {k} + 1) - lgamma({n} + 1) - lgamma({a} + 1) - lgamma({r} - {a} + 1) - lgamma({k} - {a} + 1) - lgamma({n} - {r} - {k} + {a} + 1))",
}


def fisher_sql(a: str, b: str, c: str, d: str, relative: bool = True) -> str:
    r, k, n = f"({a} + {b})", f"({a} + {c})", f"({a} + {b} + {c} + {d})"
    own = MACRO["own"].format(r=r, k=k, n=n, a=a)
    most = f"{own} * (1 + 1e-7)" if relative else f"{own} + 1e-12"
    return MACRO["fisher"].format(r=r, k=k, n=n, most=most)


def sign_sql(pos: str, neg: str) -> str:
    return f"CASE WHEN {pos} + {neg} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(generate_series(0, least({pos}, {neg})), lambda i: exp(lgamma({pos} + {neg} + 1) - lgamma(i + 1) - lgamma({pos} + {neg} - i + 1) - ({pos} + {neg}) * ln(2.0))))) END"


def bh_sql(source: str, p: str, q: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT * EXCLUDE (_rk, _n), least(1.0, min({p} * _n / _rk) OVER ({part} ORDER BY _rk DESC ROWS UNBOUNDED PRECEDING)) AS {q}
  FROM (SELECT *, row_number() OVER ({part} ORDER BY {p}) AS _rk, count(*) OVER ({part}) AS _n FROM {source})"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles as both engines agree on them, motifs as text, whole numbers as long."""
    pick = {"double": lambda c: (F.round(c, digits) + F.lit(0.0)).alias(c), "array<string>": lambda c: F.array_join(c, "|").alias(c), "int": lambda c: F.col(c).cast("long").alias(c)}
    return df.select(*(pick.get(t, F.col)(c) for c, t in df.dtypes))


def r8(expr: str, name: str) -> str:
    return f"round({expr}, 8) + 0.0 AS {name}"


COUNTS = "c AS (SELECT motif, k, count(*) FILTER (is_correct) AS a, count(*) FILTER (NOT is_correct) AS b FROM g GROUP BY ALL)"
SCORES = ", ".join([
    "motif", "a AS success_count", "b AS failure_count", r8("a / s", "success_support"), r8("b / f", "failure_support"), r8("a / s - b / f", "support_difference"), r8("(a / s) / (b / f + 1e-9)", "lift"),
    r8("ln((a + 0.5) / (s - a + 0.5)) - ln((b + 0.5) / (f - b + 0.5))", "log_odds_ratio"), r8("abs(a / s - b / f)", "abs_support_difference"), r8("abs(ln((a + 0.5) / (s - a + 0.5)) - ln((b + 0.5) / (f - b + 0.5)))", "abs_log_odds_ratio"),
])
G13, G12 = NGRAMS.format(low=1, high=3), NGRAMS.format(low=1, high=2)


@query("ngram_scores", f"WITH {T1}, {TOTALS}, {G13}, {COUNTS} SELECT {SCORES} FROM c, n WHERE a + b >= 3")
def ngram_scores(spark, d):
    return rounded(mining.mine_ngrams(event_traces(spark, d)))


LEVELS = """p1 AS (SELECT trace_id, is_correct, i AS last, [tokens[i]] AS m FROM (SELECT *, unnest(generate_series(1, len(tokens))) AS i FROM t)),
p2 AS (SELECT DISTINCT p.trace_id, p.is_correct, q.last, list_append(p.m, q.m[1]) AS m FROM p1 p JOIN p1 q ON q.trace_id = p.trace_id AND q.last > p.last AND q.last - p.last <= {gap}),
p3 AS (SELECT DISTINCT p.trace_id, p.is_correct, q.last, list_append(p.m, q.m[1]) AS m FROM p2 p JOIN p1 q ON q.trace_id = p.trace_id AND q.last > p.last AND q.last - p.last <= {gap}),
p4 AS (SELECT DISTINCT p.trace_id, p.is_correct, q.last, list_append(p.m, q.m[1]) AS m FROM p3 p JOIN p1 q ON q.trace_id = p.trace_id AND q.last > p.last AND q.last - p.last <= {gap})"""
SKIPS = LEVELS.format(gap=3) + ", g AS (SELECT DISTINCT trace_id, is_correct, array_to_string(m, '|') AS motif, len(m) AS k FROM (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4))"
SUBS = LEVELS.format(gap=1_000_000) + ", g AS (SELECT DISTINCT trace_id, is_correct, array_to_string(m, '|') AS motif, len(m) AS k FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4))"
TESTED = SCORES.replace("motif,", "motif, " + f"{fisher_sql('a', '(s - a)', 'b', '(f - b)')} AS p,", 1)


def tested_sql(where: str, source: str = "c, n") -> str:
    body = bh_sql(f"(SELECT {TESTED} FROM {source} WHERE {where})", "p", "q")
    return f"SELECT * EXCLUDE (p, q), {r8('p', 'p_value')}, {r8('q', 'q_value')} FROM ({body})"


@query("skipgrams", f"WITH {T1}, {TOTALS}, {SKIPS}, {COUNTS} {tested_sql('a + b >= 5')}")
def skipgrams(spark, d):
    return rounded(mining.mine_skipgrams(event_traces(spark, d)))


CUT = "d AS (SELECT motif, k, CASE WHEN a >= 5 THEN a ELSE 0 END AS a, CASE WHEN b >= 5 THEN b ELSE 0 END AS b FROM c)"


@query("patterns", f"WITH {T1}, {TOTALS}, {SUBS}, {COUNTS}, {CUT} {tested_sql('a + b > 0', 'd, n')}")
def patterns(spark, d):
    return rounded(mining.pattern_table(event_traces(spark, d)))


@query("frequent_prefixspan", f"WITH {T1}, {SUBS} SELECT motif, count(*) AS count FROM g GROUP BY 1 HAVING count(*) >= 5")
def frequent_prefixspan(spark, d):
    return rounded(mining.frequent(event_traces(spark, d), 5, 1, 4, "prefixspan"))


# one pass for each length from the longest down: a pattern goes if a longer kept one holds it
PART = "v{n} AS (SELECT motif AS whole, sa, sb, ad, array_to_string(list_transform(list_filter(generate_series(1, len(mt)), lambda i: (mask >> (i - 1)) & 1 = 1), lambda i: mt[i]), '|') AS part FROM ({kept}), generate_series(1, 14) q(mask) WHERE mask < (1 << len(mt)) - 1)"
LEVEL = "k{n} AS (SELECT * FROM w WHERE k = {n} AND NOT EXISTS (SELECT 1 FROM v{n} WHERE part = w.motif AND abs(w.sa - v{n}.sa) <= 0.02 AND abs(w.sb - v{n}.sb) <= 0.02 AND v{n}.ad >= w.ad))"
KEPT = {n: " UNION ALL ".join(f"SELECT * FROM k{m}" for m in range(4, n, -1)) for n in (3, 2, 1)}
REDUCED = "w AS (SELECT *, string_split(motif, '|') AS mt, a / s AS sa, b / f AS sb, abs(a / s - b / f) AS ad FROM d, n WHERE a + b > 0), k4 AS (SELECT * FROM w WHERE k = 4), " + ", ".join(f"{PART.format(n=n, kept=KEPT[n])}, {LEVEL.format(n=n)}" for n in (3, 2, 1))


@query("patterns_reduced", f"WITH {T1}, {TOTALS}, {SUBS}, {COUNTS}, {CUT}, {REDUCED} SELECT {SCORES} FROM ({KEPT[1]} UNION ALL SELECT * FROM k1)")
def patterns_reduced(spark, d):
    return rounded(mining.without_redundant(mining.pattern_table(event_traces(spark, d), tests=False)))


RULES = f"""WITH {T1}, {TOTALS}, {SUBS}, {COUNTS},
top AS (SELECT motif, k, a, b FROM c WHERE a + b >= 5 ORDER BY a + b DESC, motif LIMIT 80),
w AS (
  SELECT c.motif, x.motif AS antecedent, y.motif AS consequent, c.a, c.b, x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb
  FROM c, top x, top y WHERE c.a + c.b >= 5 AND x.motif <> y.motif AND c.motif = x.motif || '|' || y.motif
)
SELECT motif, antecedent, consequent, a AS success_count, b AS failure_count,
  {r8("CASE WHEN xa > 0 THEN a / xa ELSE 0 END", "success_confidence")}, {r8("CASE WHEN xb > 0 THEN b / xb ELSE 0 END", "failure_confidence")},
  {r8("CASE WHEN xa > 0 THEN a / xa ELSE 0 END / (ya / s + 1e-9)", "success_rule_lift")}, {r8("CASE WHEN xb > 0 THEN b / xb ELSE 0 END / (yb / f + 1e-9)", "failure_rule_lift")},
  {r8("CASE WHEN xa > 0 THEN a / xa ELSE 0 END - CASE WHEN xb > 0 THEN b / xb ELSE 0 END", "confidence_difference")}
FROM w, n"""


@query("rules", RULES)
def rules(spark, d):
    out = mining.mine_rules(event_traces(spark, d), tests=False)
    return rounded(out.select("motif", "antecedent", "consequent", "success_count", "failure_count", "success_confidence", "failure_confidence", "success_rule_lift", "failure_rule_lift", "confidence_difference"))


@query("top_motifs", f"""WITH {T1}, {TOTALS}, {G13}, {COUNTS}, x AS (SELECT motif, a / s AS sa, b / f AS sb, abs(ln((a + 0.5) / (s - a + 0.5)) - ln((b + 0.5) / (f - b + 0.5))) AS lo FROM c, n WHERE a + b >= 3)
SELECT 'success' AS direction, row_number() OVER (ORDER BY sa - sb DESC, sa DESC, lo DESC, motif) AS rank, motif FROM x QUALIFY rank <= 20
UNION ALL SELECT 'failure', row_number() OVER (ORDER BY sa - sb, sb DESC, lo DESC, motif) AS rank, motif FROM x QUALIFY rank <= 20""")
def top_motifs(spark, d):
    return rounded(mining.ranked(mining.mine_ngrams(event_traces(spark, d)), 20).select("direction", "rank", "motif"))


@query("v1_motifs", f"""WITH {T1}, {NGRAMS.format(low=2, high=4)}, {COUNTS} SELECT motif, replace(motif, '|', ' -> ') AS motif_pretty, CAST(k AS BIGINT) AS length, a + b AS support_total, a AS support_correct, b AS support_incorrect,
  printf('%.6f', a / (a + b)) AS p_correct, printf('%.6f', b / (a + b)) AS p_incorrect, printf('%.6f', (a + 1) / (b + 1)) AS enrichment_correct, printf('%.6f', (b + 1) / (a + 1)) AS enrichment_incorrect,
  CASE WHEN a > b THEN 'correct' WHEN b > a THEN 'incorrect' ELSE 'tie' END AS dominant_label FROM c""")
def v1_motifs(spark, d):
    return rounded(mining.v1_motifs(event_traces(spark, d)))


@query("indicators", f"""WITH {T1}, {TOTALS}, {G13}, {COUNTS} SELECT motif, CAST(k AS BIGINT) AS motif_len, a + b AS support_total, a AS support_correct, b AS support_incorrect, {r8("(a + b) / (s + f)", "support_rate")},
  {r8("a / (a + b)", "p_correct_given_motif")}, {r8("b / (a + b)", "p_incorrect_given_motif")}, {r8("a / (a + b) - s / (s + f)", "delta_correct_vs_baseline")}, {r8("(a / (a + b)) / (s / (s + f))", "lift_correct")}, {r8("(b / (a + b)) / (f / (s + f))", "lift_incorrect")},
  {r8("ln((a + 0.5) / (s - a + 0.5)) - ln((b + 0.5) / (f - b + 0.5))", "log_odds_ratio")}, CASE WHEN a / (a + b) - s / (s + f) >= 0 THEN 'success' ELSE 'failure' END AS indicator_direction, {r8("abs(a / (a + b) - s / (s + f))", "indicator_strength")}
FROM c, n WHERE a + b >= 3""")
def indicators(spark, d):
    return rounded(mining.indicators(event_traces(spark, d)))


INDEX = f"""{NGRAMS.format(low=2, high=4)}, {COUNTS}, x AS (SELECT motif, greatest(0, ln(CAST(printf('%.6f', (a + 1) / (b + 1)) AS DOUBLE))) * ln(1 + a + b) AS up, greatest(0, ln(CAST(printf('%.6f', (b + 1) / (a + 1)) AS DOUBLE))) * ln(1 + a + b) AS down FROM c WHERE a + b >= 5)"""


@query("critical_steps", f"""WITH {T1}, {INDEX}, o AS (SELECT trace_id, array_to_string(list_slice(tokens, i, i + k - 1), '|') AS motif FROM t, generate_series(2, 4) a(k), generate_series(1, len(tokens)) b(i) WHERE i + k - 1 <= len(tokens)),
h AS (SELECT trace_id, sum(up) AS up, sum(down) AS down FROM o JOIN x USING (motif) GROUP BY 1)
SELECT trace_id, is_correct, {r8("coalesce(up, 0)", "success_signal")}, {r8("coalesce(down, 0)", "failure_signal")}, {r8("coalesce(up, 0) - coalesce(down, 0)", "net_signal")} FROM t LEFT JOIN h USING (trace_id)""")
def critical_steps(spark, d):
    t = event_traces(spark, d)
    out = mining.critical_steps(t, mining.motif_index(mining.v1_motifs(t)), 2, 4, strings=False)
    return rounded(out.select("trace_id", "is_correct", "success_signal", "failure_signal", "net_signal"))


@query("critical_step_strings")
def critical_step_strings(spark, d):
    """The strings of strongest motifs and steps; tests hold them against plain Python."""
    t = event_traces(spark, d)
    return mining.critical_steps(t, mining.motif_index(mining.v1_motifs(t)), 2, 4).select("trace_id", "top_success_motifs", "top_failure_motifs", "top_success_steps", "top_failure_steps")


@query("corpus_summary", f"""WITH {T1} SELECT count(*) AS traces, count(DISTINCT question_id) AS questions, count(*) FILTER (is_correct) AS success, count(*) FILTER (NOT is_correct) AS failure, {r8("avg(CAST(is_correct AS INT))", "success_rate")},
  {r8("avg(len(tokens))", "mean_len")}, {r8("median(len(tokens))", "median_len")}, min(len(tokens)) AS min_len, max(len(tokens)) AS max_len FROM t""")
def corpus_summary(spark, d):
    return rounded(corpus.corpus_summary(event_traces(spark, d)))


@query("question_stats", f"""WITH {T1} SELECT question_id, count(*) AS total, count(*) FILTER (is_correct) AS "right", count(*) FILTER (NOT is_correct) AS wrong, {r8("avg(len(tokens))", "avg_len")}, {r8("avg(CAST(is_correct AS INT))", "accuracy")},
  count(*) FILTER (is_correct) > 0 AND count(*) FILTER (NOT is_correct) > 0 AS is_mixed, CAST(1.0 AS DOUBLE) AS acceptance_rate, {r8("100.0 * avg(CAST(is_correct AS INT))", "percent_correct")} FROM t GROUP BY 1 HAVING count(*) >= 5""")
def question_stats(spark, d):
    return rounded(corpus.question_stats(event_traces(spark, d), 5))


@query("document_frequency", f"WITH {T1} SELECT tok AS token, count(DISTINCT trace_id) AS documents FROM (SELECT trace_id, unnest(tokens) AS tok FROM t) GROUP BY 1")
def document_frequency(spark, d):
    return rounded(corpus.document_frequency(event_traces(spark, d)))


@query("bag_of_words", f"WITH {T1} SELECT tok AS token, count(*) AS count, {r8('count(*) / sum(count(*)) OVER ()', 'relative_frequency')} FROM (SELECT unnest(tokens) AS tok FROM t) GROUP BY 1")
def bag_of_words(spark, d):
    return rounded(corpus.bag_of_words(event_traces(spark, d)))


@query("answer_distribution", f"""WITH {T1}, x AS (SELECT question_id, predicted_answer, count(*) AS count, min(trace_id) AS seen FROM t GROUP BY 1, 2)
SELECT question_id, predicted_answer, count, {r8("count / sum(count) OVER (PARTITION BY question_id)", "share")}, row_number() OVER (PARTITION BY question_id ORDER BY count DESC, seen) AS rank FROM x""")
def answer_distribution(spark, d):
    return rounded(corpus.answer_distribution(event_traces(spark, d)))


@query("distinct_traces", f"WITH {T1} SELECT question_id, min(trace_id) AS trace_id, array_to_string(tokens, '|') AS tokens FROM t WHERE len(tokens) >= 2 GROUP BY question_id, t.tokens")
def distinct_traces(spark, d):
    return rounded(corpus.distinct_traces(corpus.of_length(event_traces(spark, d), 2), per_question=True).select("question_id", "trace_id", "tokens"))


@query("first_questions", f"WITH {T1}, q AS (SELECT question_id FROM t GROUP BY 1 ORDER BY min(trace_id) LIMIT 10) SELECT trace_id, is_correct FROM t WHERE question_id IN (SELECT question_id FROM q)")
def first_questions(spark, d):
    return corpus.first_questions(event_traces(spark, d), 10).select("trace_id", "is_correct")


@query("sampled_report", f"""WITH {T1}, c AS (SELECT question_id, predicted_answer AS norm, count(*) AS n, min(trace_id) AS seen FROM t GROUP BY 1, 2), m AS (SELECT question_id, arg_min(norm, ROW(-n, seen)) AS majority_answer, count(*) AS distinct_answers FROM c GROUP BY 1)
SELECT question_id, count(*) AS attempts, count(*) FILTER (is_correct) AS "right", {r8("avg(len(tokens))", "avg_words")}, CASE WHEN count(*) FILTER (is_correct) = count(*) THEN 'easy' WHEN count(*) FILTER (is_correct) = 0 THEN 'failed' ELSE 'mixed' END AS bucket, any_value(majority_answer) AS majority_answer, any_value(distinct_answers) AS distinct_answers
FROM t JOIN m USING (question_id) GROUP BY 1""")
def sampled_report(spark, d):
    return rounded(corpus.sampled_report(event_traces(spark, d)))


MIXED = "m AS (SELECT * FROM t WHERE question_id IN (SELECT question_id FROM t GROUP BY 1 HAVING min(CAST(is_correct AS INT)) <> max(CAST(is_correct AS INT))))"
QT = "q AS (SELECT question_id, count(*) AS n, count(*) FILTER (is_correct) AS s, avg(len(tokens)) AS al FROM m GROUP BY 1)"
HELD = "h AS (SELECT question_id, token, count(*) AS nw, count(*) FILTER (is_correct) AS sw FROM (SELECT DISTINCT trace_id, question_id, is_correct, {token} AS token FROM m, generate_series(1, len(tokens)) a(i) WHERE i <= len(tokens)) GROUP BY 1, 2)"
PQ = "p AS (SELECT h.*, n, s, al, CASE WHEN n > nw THEN sw / nw - (s - sw) / (n - nw) END AS d, s / n AS b FROM h JOIN q USING (question_id))"
DELTA = """x AS (SELECT token, count(*) AS question_presence, count(d) AS questions_used, avg(d) AS mean_delta, median(d) AS median_delta, avg(b) FILTER (d IS NOT NULL) AS mean_question_baseline, median(b) FILTER (d IS NOT NULL) AS median_question_baseline,
  count(*) FILTER (d > 0) AS sign_pos, count(*) FILTER (d < 0) AS sign_neg, avg(al) FILTER (d IS NOT NULL) AS avg_question_trace_len FROM p GROUP BY 1 HAVING count(*) >= {least} AND count(d) > 0)"""
SIGNED = f"y AS (SELECT *, sign_pos + sign_neg AS sign_n_nonzero, {sign_sql('sign_pos', 'sign_neg')} AS sign_test_p FROM x)"
DELTAS = f"{MIXED}, {QT}, {HELD.format(token='tokens[i]')}, {PQ}, {DELTA.format(least=10)}, {SIGNED}"


@query("token_deltas", f"""WITH {T1}, {DELTAS}, z AS ({bh_sql("y", "sign_test_p", "bh_q")}), l AS (SELECT CASE WHEN max(avg_question_trace_len) - min(avg_question_trace_len) > 1e-9 THEN regr_slope(mean_delta, avg_question_trace_len) END AS sl, avg(mean_delta) AS my, avg(avg_question_trace_len) AS mx FROM y)
SELECT token, question_presence, questions_used, {", ".join(r8(c, c) for c in ("mean_delta", "median_delta", "mean_question_baseline", "median_question_baseline"))}, sign_pos, sign_neg, {r8("avg_question_trace_len", "avg_question_trace_len")}, sign_n_nonzero, {r8("sign_test_p", "sign_test_p")}, {r8("bh_q", "bh_q")},
  {r8("mean_delta - my - coalesce(sl, 0) * (avg_question_trace_len - mx)", "length_control_residual")} FROM z, l""")
def token_deltas(spark, d):
    return rounded(within.token_deltas(event_traces(spark, d)))


@query("per_question_deltas", f"WITH {T1}, {DELTAS} SELECT question_id, token, nw AS n_with, n - nw AS n_without, {r8('b', 'baseline')}, {r8('d', 'delta_q')} FROM p WHERE d IS NOT NULL")
def per_question_deltas(spark, d):
    return rounded(within.per_question(within.mixed(event_traces(spark, d)), F.col("tokens")).filter("delta_q is not null").select("question_id", "token", "n_with", "n_without", "baseline", "delta_q"))


BUCKETS = f"""{MIXED}, {QT}, k AS (SELECT question_id, token, trace_id, any_value(is_correct) AS is_correct, count(*) AS k FROM (SELECT *, unnest(tokens) AS token FROM m) GROUP BY 1, 2, 3),
p AS (SELECT question_id, token, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 1 AND is_correct) AS s1, count(*) FILTER (k >= 2) AS n2, count(*) FILTER (k >= 2 AND is_correct) AS s2 FROM k GROUP BY 1, 2),
e AS (SELECT token, CASE WHEN n1 > 0 AND n > n1 + n2 THEN s1 / n1 - (s - s1 - s2) / (n - n1 - n2) END AS d1, CASE WHEN n2 > 0 AND n > n1 + n2 THEN s2 / n2 - (s - s1 - s2) / (n - n1 - n2) END AS d2 FROM p JOIN q USING (question_id)),
x AS (SELECT token, count(*) AS question_presence, count(d1) AS n1, coalesce(avg(d1), 0) AS m1, coalesce(median(d1), 0) AS e1, count(*) FILTER (d1 > 0) AS a1, count(*) FILTER (d1 < 0) AS b1, count(d2) AS n2, coalesce(avg(d2), 0) AS m2, coalesce(median(d2), 0) AS e2, count(*) FILTER (d2 > 0) AS a2, count(*) FILTER (d2 < 0) AS b2 FROM e GROUP BY 1 HAVING count(*) >= 10 AND count(d1) + count(d2) > 0),
y AS (SELECT *, {sign_sql("a1", "b1")} AS p1, {sign_sql("a2", "b2")} AS p2 FROM x),
u AS (SELECT token, 1 AS side, p1 AS p FROM y UNION ALL SELECT token, 2, p2 FROM y), v AS ({bh_sql("u", "p", "q")})"""


@query("count_buckets", f"""WITH {T1}, {BUCKETS} SELECT y.token, question_presence, n1 AS n_q_1_vs_0, {r8("m1", "mean_delta_1_vs_0")}, {r8("e1", "median_delta_1_vs_0")}, n2 AS n_q_2plus_vs_0, {r8("m2", "mean_delta_2plus_vs_0")}, {r8("e2", "median_delta_2plus_vs_0")},
  {r8("p1", "p_1_vs_0")}, {r8("p2", "p_2plus_vs_0")}, {r8("(SELECT q FROM v WHERE v.token = y.token AND side = 1)", "q_1_vs_0")}, {r8("(SELECT q FROM v WHERE v.token = y.token AND side = 2)", "q_2plus_vs_0")} FROM y""")
def count_buckets(spark, d):
    return rounded(within.count_buckets(event_traces(spark, d)))


BIN = "tokens[i] || '@@' || CASE WHEN (i - 0.5) / len(tokens) < 1/3 THEN 'first' WHEN (i - 0.5) / len(tokens) < 2/3 THEN 'middle' ELSE 'last' END"


@query("position_deltas", f"""WITH {T1}, {DELTAS}, h2 AS (SELECT * FROM ({HELD.format(token=BIN)[6:-1]})), p2 AS (SELECT h2.*, n, s, CASE WHEN n > nw THEN sw / nw - (s - sw) / (n - nw) END AS d FROM h2 JOIN q USING (question_id)),
x2 AS (SELECT token, count(*) AS question_presence, count(d) AS questions_used, avg(d) AS mean_delta FROM p2 GROUP BY 1 HAVING count(*) >= 10 AND count(d) > 0)
SELECT x2.token, x2.question_presence, x2.questions_used, {r8("x2.mean_delta", "mean_delta")}, {r8("coalesce(x.mean_delta, 0)", "collapsed_delta")}, {r8("CASE WHEN coalesce(x.mean_delta, 0) = 0 THEN 0 ELSE abs(x2.mean_delta) / abs(x.mean_delta) END", "lift_ratio")} FROM x2 LEFT JOIN x ON x.token = split_part(x2.token, '@@', 1)""")
def position_deltas(spark, d):
    return rounded(within.position_deltas(event_traces(spark, d)).select("token", "question_presence", "questions_used", "mean_delta", "collapsed_delta", "lift_ratio"))


@query("first_action_deltas", f"""WITH {T2.replace("tokens, o_orderstatus", "[tokens[1]] AS tokens, o_orderstatus")}, {MIXED}, {QT}, {HELD.format(token='tokens[i]')}, {PQ}, {DELTA.format(least=2)}, c AS (SELECT tokens[1] AS token, count(*) AS count, count(DISTINCT question_id) AS n_questions, avg(CAST(is_correct AS INT)) AS r FROM t GROUP BY 1)
SELECT token, count, n_questions, {r8("r", "success_rate")}, {r8("mean_delta", "mean_delta")}, questions_used FROM c LEFT JOIN x USING (token)""")
def first_action_deltas(spark, d):
    return rounded(within.first_action_deltas(order_traces(spark, d)).select("token", "count", "n_questions", "success_rate", "mean_delta", "questions_used"))


@query("prefix_leaderboard", f"""WITH {T1.replace("t AS (", "t0 AS (", 1)}, t AS (SELECT fr AS fraction, trace_id, question_id, is_correct, list_slice(tokens, 1, greatest(1, CAST(ceil(len(tokens) * fr) AS INT))) AS tokens FROM t0, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(fr)), {MIXED},
q AS (SELECT fraction, question_id, count(*) AS n, count(*) FILTER (is_correct) AS s FROM m GROUP BY ALL), h AS (SELECT fraction, question_id, token, count(*) AS nw, count(*) FILTER (is_correct) AS sw FROM (SELECT DISTINCT fraction, trace_id, question_id, is_correct, unnest(tokens) AS token FROM m) GROUP BY ALL),
p AS (SELECT *, CASE WHEN n > nw THEN sw / nw - (s - sw) / (n - nw) END AS d FROM h JOIN q USING (fraction, question_id))
SELECT fraction, token, count(d) AS questions_used, {r8("avg(d)", "mean_delta")}, {r8("avg(CAST(d > 0 AS INT))", "positive_fraction")}, CAST(sum(nw) AS BIGINT) AS support FROM p GROUP BY ALL HAVING count(d) >= 10""")
def prefix_leaderboard(spark, d):
    return rounded(within.prefix_leaderboard(event_traces(spark, d)))


LENGTHS = """k AS (SELECT question_id, count(*) AS n_total, count(*) FILTER (is_correct) AS n1, count(*) FILTER (NOT is_correct) AS n0, avg(len(tokens)) FILTER (is_correct) AS m1, avg(len(tokens)) FILTER (NOT is_correct) AS m0, median(len(tokens)) FILTER (is_correct) AS e1, median(len(tokens)) FILTER (NOT is_correct) AS e0,
  var_samp(len(tokens)) FILTER (is_correct) AS v1, var_samp(len(tokens)) FILTER (NOT is_correct) AS v0 FROM t GROUP BY 1),
l AS (SELECT *, n1 >= 2 AND n0 >= 2 AS ok, m1 - m0 AS d FROM k),
ce AS (SELECT a.question_id, avg(CASE WHEN len(a.tokens) > len(b.tokens) THEN 1.0 WHEN len(a.tokens) = len(b.tokens) THEN 0.5 ELSE 0 END) AS c FROM t a JOIN t b ON a.question_id = b.question_id AND a.is_correct AND NOT b.is_correct GROUP BY 1)"""


@query("lengths_by_question", f"""WITH {T1}, {LENGTHS} SELECT question_id, n_total, n1 AS n_correct, n0 AS n_incorrect, {r8("CASE WHEN ok THEN m1 END", "mean_len_correct")}, {r8("CASE WHEN ok THEN m0 END", "mean_len_incorrect")}, {r8("CASE WHEN ok THEN e1 END", "median_len_correct")}, {r8("CASE WHEN ok THEN e0 END", "median_len_incorrect")},
  {r8("CASE WHEN ok THEN c END", "common_language_effect")}, {r8("CASE WHEN ok THEN d END", "delta_mean")}, {r8("CASE WHEN ok THEN CASE WHEN (n1 - 1) * v1 + (n0 - 1) * v0 = 0 THEN 0 ELSE d / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) END END", "cohen_d")},
  CASE WHEN NOT ok THEN 'insufficient_data' WHEN d > 0 THEN 'correct_longer' WHEN d < 0 THEN 'incorrect_longer' ELSE 'equal' END AS direction FROM l LEFT JOIN ce USING (question_id)""")
def lengths_by_question(spark, d):
    return rounded(within.lengths_by_question(event_traces(spark, d)))


@query("length_summary", f"""WITH {T1}, {LENGTHS}, x AS (SELECT * FROM l WHERE ok), y AS (SELECT count(*) AS n_valid_questions, sum(d * n_total) / sum(n_total) AS w, avg(d) AS u, median(d) AS e, count(*) FILTER (d > 0) AS a, count(*) FILTER (d < 0) AS b, count(*) FILTER (d = 0) AS c FROM x)
SELECT n_valid_questions, {r8("w", "weighted_mean_delta")}, {r8("u", "unweighted_mean_delta")}, {r8("e", "median_delta")}, a AS questions_correct_longer, b AS questions_incorrect_longer, c AS questions_equal, {r8("a / (a + b)", "fraction_correct_longer")}, {r8(sign_sql("a", "b"), "sign_test_p")} FROM y""")
def length_summary(spark, d):
    return rounded(within.length_summary(within.lengths_by_question(event_traces(spark, d))))


@query("nearest_length_pairs", f"""WITH {T1}, x AS (SELECT a.question_id, a.trace_id AS success_id, b.trace_id AS failure_id, len(a.tokens) AS success_len, len(b.tokens) AS failure_len FROM t a JOIN t b ON a.question_id = b.question_id AND a.is_correct AND NOT b.is_correct AND abs(len(a.tokens) - len(b.tokens)) <= 1)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY success_id ORDER BY abs(success_len - failure_len), failure_id) = 1""")
def nearest_length_pairs(spark, d):
    return rounded(within.nearest_length_pairs(event_traces(spark, d)))


CARD = f"""{NGRAMS.format(low=2, high=3)}, w AS (SELECT *, string_split(motif, '|') AS mt FROM g),
o AS (SELECT *, CASE WHEN len(tokens) = k THEN 0.5 ELSE (list_min(list_filter(generate_series(1, len(tokens) - k + 1), lambda i: list_slice(tokens, i, i + k - 1) = mt)) - 1) / greatest(1, len(tokens) - k) END AS pos FROM w),
c AS (SELECT motif, count(*) AS sup, count(*) FILTER (is_correct) AS a, count(*) FILTER (NOT is_correct) AS b, count(DISTINCT question_id) AS qc, avg(pos) AS pos, avg(len(tokens)) AS al FROM o GROUP BY 1 HAVING count(*) >= 8),
e AS (SELECT *, s - a AS c0, f - b AS d0, a / sup AS pr, CASE WHEN s + f > sup THEN (s - a) / (s + f - sup) ELSE s / (s + f) END AS ab, ((a + 0.5) * (f - b + 0.5)) / ((b + 0.5) * (s - a + 0.5)) AS orr, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (s - a + 0.5) + 1 / (f - b + 0.5)) AS se FROM c, n),
x AS (SELECT *, {fisher_sql("a", "b", "c0", "d0", False)} AS p FROM e)"""


@query("motif_cards", f"""WITH {T1}, {TOTALS}, {CARD}, z AS ({bh_sql("x", "p", "qv")})
SELECT motif, sup AS support, a AS success_present, b AS failure_present, qc AS question_coverage, {r8("pos", "avg_stage_position")}, {r8("al", "avg_trace_length_present")}, {r8("sup / (s + f)", "prevalence")}, {r8("pr", "success_rate_present")}, {r8("ab", "success_rate_absent")}, {r8("pr - ab", "support_difference")},
  {r8("pr / (s / (s + f))", "lift_overall_success")}, {r8("orr", "odds_ratio")}, {r8("exp(ln(orr) - 1.96 * se)", "odds_ratio_ci_low")}, {r8("exp(ln(orr) + 1.96 * se)", "odds_ratio_ci_high")}, {r8("p", "fisher_p_value")}, {r8("qv", "fdr_q_value")}, CASE WHEN pos < 0.34 THEN 'early' WHEN pos < 0.67 THEN 'middle' ELSE 'late' END AS stage_bucket,
  (SELECT string_agg(trace_id, '|' ORDER BY trace_id) FROM (SELECT trace_id FROM g WHERE g.motif = z.motif ORDER BY trace_id LIMIT 3)) AS examples FROM z""")
def motif_cards(spark, d):
    return rounded(cards.motif_cards(event_traces(spark, d)).drop("noise_cooccurrence_rate"))


@query("card_families", f"""WITH {T1}, {TOTALS}, {CARD}, y AS (SELECT motif, sup, pr - ab AS d FROM x)
SELECT 'top' AS family, row_number() OVER (ORDER BY abs(d) DESC, sup DESC, motif) AS rank, motif FROM y QUALIFY rank <= 15
UNION ALL SELECT 'success', row_number() OVER (ORDER BY d DESC, sup DESC, motif) AS rank, motif FROM y WHERE d > 0 QUALIFY rank <= 15
UNION ALL SELECT 'failure', row_number() OVER (ORDER BY d, sup DESC, motif) AS rank, motif FROM y WHERE d < 0 QUALIFY rank <= 15""")
def card_families(spark, d):
    return rounded(cards.families(cards.motif_cards(event_traces(spark, d), examples=0)).select("family", "rank", "motif"))


@query("card_neighbours", f"""WITH {T1}, {TOTALS}, {CARD}, h AS (SELECT DISTINCT trace_id, replace(g.motif, '|', ' ') AS motif FROM g JOIN c USING (motif)), m AS (SELECT motif, count(*) AS n FROM h GROUP BY 1),
y AS (SELECT a.motif, b.motif AS other, count(*) AS overlap FROM h a JOIN h b ON a.trace_id = b.trace_id AND a.motif <> b.motif GROUP BY 1, 2)
SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY overlap / n DESC, other DESC) AS rank, other, overlap, {r8("overlap / n", "overlap_rate")} FROM y JOIN m USING (motif) QUALIFY rank <= 5""")
def card_neighbours(spark, d):
    t = event_traces(spark, d)
    return rounded(cards.neighbours(t, cards.motif_cards(t, examples=0)))


@query("card_coverage", f"""WITH {T1}, {TOTALS}, {CARD}, y AS (SELECT motif FROM x ORDER BY abs(pr - ab) DESC, sup DESC, motif LIMIT 5), h AS (SELECT DISTINCT trace_id, question_id FROM g JOIN y USING (motif))
SELECT count(*) AS covered_traces, count(DISTINCT question_id) AS covered_questions, (SELECT count(*) FROM t) AS traces, (SELECT count(DISTINCT question_id) FROM t) AS questions, {r8("count(*) / (SELECT count(*) FROM t)", "trace_fraction")}, {r8("count(DISTINCT question_id) / (SELECT count(DISTINCT question_id) FROM t)", "question_fraction")} FROM h""")
def card_coverage(spark, d):
    t = event_traces(spark, d)
    return rounded(cards.coverage(t, cards.families(cards.motif_cards(t, examples=0), 5).filter("family = 'top'")))


@query("question_bundles", f"""WITH {T1}, {NGRAMS.format(low=2, high=3)}, m AS (SELECT question_id, count(*) AS tot, count(*) FILTER (is_correct) AS s FROM t GROUP BY 1), c AS (SELECT question_id, motif, count(*) AS support, count(*) FILTER (is_correct) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT question_id, motif, support, a AS success_present, {r8("a / support - CASE WHEN tot > support THEN (s - a) / (tot - support) ELSE s / tot END", "support_difference")} FROM c JOIN m USING (question_id)""")
def question_bundles(spark, d):
    return rounded(cards.motif_cards(event_traces(spark, d), 2, 3, 2, examples=0, by=("question_id",)).select("question_id", "motif", "support", "success_present", "support_difference"))


EXACT = "least(1.0, list_sum(list_transform(list_filter(generate_series(greatest(0, a + b - f), least(s, a + b)), lambda x: abs(x * f - (a + b - x) * s) >= abs(a * f - b * s)), lambda x: exp(lgamma(s + 1) + lgamma(f + 1) + lgamma(a + b + 1) + lgamma(s + f - a - b + 1) - lgamma(s + f + 1) - lgamma(x + 1) - lgamma(s - x + 1) - lgamma(a + b - x + 1) - lgamma(f - a - b + x + 1)))))"


@query("local_motifs", f"""WITH {T1}, {G13}, z AS (SELECT question_id, count(*) FILTER (is_correct) AS s, count(*) FILTER (NOT is_correct) AS f FROM t GROUP BY 1 HAVING s >= 2 AND f >= 2),
c AS (SELECT question_id, motif, count(*) FILTER (is_correct) AS a, count(*) FILTER (NOT is_correct) AS b FROM g GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT *, {EXACT} AS p FROM c JOIN z USING (question_id)), y AS ({bh_sql("x", "p", "q", "question_id")})
SELECT question_id, motif, a AS success_count, b AS failure_count, {r8("a / s - b / f", "support_delta")}, {r8("ln((a + 0.5) / (s - a + 0.5)) - ln((b + 0.5) / (f - b + 0.5))", "log_odds_ratio")}, {r8("p", "p_value")}, {r8("q", "q_value")} FROM y""")
def local_motifs(spark, d):
    return rounded(cards.local_motifs(event_traces(spark, d)).select("question_id", "motif", "success_count", "failure_count", "support_delta", "log_odds_ratio", "p_value", "q_value"))


SEP = f"""{G13}, z AS (SELECT question_id, count(*) FILTER (is_correct) AS s, count(*) FILTER (NOT is_correct) AS f FROM t GROUP BY 1 HAVING s > 0 AND f > 0),
c AS (SELECT question_id, motif, count(*) FILTER (is_correct) AS a, count(*) FILTER (NOT is_correct) AS b FROM g GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT question_id, motif, a / s AS sa, b / f AS sb FROM c JOIN z USING (question_id)),
y AS (SELECT *, CASE WHEN sa - sb >= 0 THEN 'success' ELSE 'failure' END AS direction, row_number() OVER (PARTITION BY question_id, sa - sb >= 0 ORDER BY abs(sa - sb) DESC, CASE WHEN sa - sb >= 0 THEN sa ELSE sb END DESC, motif) AS rank FROM x)"""


@query("question_summaries", f"""WITH {T1}, {SEP}, b AS (SELECT question_id, count(*) AS total_traces, count(*) FILTER (is_correct) AS success_count, count(*) FILTER (NOT is_correct) AS failure_count, avg(len(tokens)) AS al, median(len(tokens)) AS ml, count(DISTINCT predicted_answer) AS distinct_answers FROM t GROUP BY 1),
u AS (SELECT question_id, max(abs(sa - sb)) AS sep, max(motif) FILTER (rank = 1 AND direction = 'success') AS up, max(motif) FILTER (rank = 1 AND direction = 'failure') AS down FROM y GROUP BY 1)
SELECT question_id, total_traces, success_count, failure_count, {r8("al", "avg_token_count")}, {r8("ml", "median_token_count")}, distinct_answers, {r8("coalesce(sep, 0)", "separation")}, up AS top_success_motif, down AS top_failure_motif, {r8("success_count / total_traces", "success_rate")},
  array_to_string(list_filter([CASE WHEN success_count > 0 AND failure_count > 0 THEN 'mixed_outcomes' END, CASE WHEN failure_count > 0 AND success_count / total_traces < 0.5 THEN 'hard_question' END, CASE WHEN distinct_answers >= 3 THEN 'high_diversity' END, CASE WHEN NOT (success_count >= 2 AND failure_count >= 2 AND (up IS NOT NULL OR down IS NOT NULL)) THEN 'low_evidence' END], lambda x: x IS NOT NULL), '|') AS tags
FROM b LEFT JOIN u USING (question_id)""")
def question_summaries(spark, d):
    return rounded(export.question_summaries(event_traces(spark, d)).drop("insights"))


@query("representative_traces", f"""WITH {T1}, {SEP}, h AS (SELECT g.trace_id, count(*) AS matches FROM g JOIN y ON g.question_id = y.question_id AND g.motif = y.motif AND g.is_correct = (y.direction = 'success') WHERE rank <= 8 GROUP BY 1), m AS (SELECT question_id, is_correct, median(len(tokens)) AS m FROM t GROUP BY 1, 2)
SELECT question_id, is_correct, row_number() OVER (PARTITION BY question_id, is_correct ORDER BY coalesce(matches, 0) DESC, abs(len(tokens) - m), trace_id) AS rank, trace_id, coalesce(matches, 0) AS matches FROM t JOIN m USING (question_id, is_correct) LEFT JOIN h USING (trace_id) QUALIFY rank <= 3""")
def representative_traces(spark, d):
    return rounded(export.representatives(event_traces(spark, d)))


@query("overview", f"""WITH {T1} SELECT 'traces' AS corpus_label, count(*) AS total_traces, count(DISTINCT question_id) AS total_questions, {r8("avg(CAST(is_correct AS INT))", "success_rate")}, {r8("avg(len(tokens))", "avg_token_count")}, {r8("median(len(tokens))", "median_token_count")} FROM t""")
def overview(spark, d):
    return rounded(export.overview(event_traces(spark, d)))


SIGNALS = "s0 AS (SELECT trace_id, question_id, is_correct, CAST(len(tokens) AS DOUBLE) AS length, CAST(len(list_distinct(tokens)) AS DOUBLE) AS kinds, len(list_distinct(tokens)) / (len(tokens) + 1e-9) AS variety FROM t)"


def signals(spark, d):
    n, k = F.size("tokens"), F.size(F.array_distinct("tokens"))
    return event_traces(spark, d).select("trace_id", "question_id", "is_correct", n.cast("double").alias("length"), k.cast("double").alias("kinds"), (k / (n + 1e-9)).alias("variety"))


@query("signal_report", f"""WITH {T1}, {SIGNALS}, u AS (SELECT unnest(['length', 'kinds', 'variety']) AS signal, unnest([length, kinds, variety]) AS x, is_correct, CAST(is_correct AS INT) AS y FROM s0),
r AS (SELECT *, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2 AS rk FROM u),
a AS (SELECT signal, corr(x, y) AS pearson, corr(rk, y) AS spearman, (sum(rk) FILTER (is_correct) - count(*) FILTER (is_correct) * (count(*) FILTER (is_correct) + 1) / 2) / (count(*) FILTER (is_correct) * count(*) FILTER (NOT is_correct)) AS auc, avg(x) FILTER (is_correct) AS m1, avg(x) FILTER (NOT is_correct) AS m0 FROM r GROUP BY 1)
SELECT signal, {r8("pearson", "pearson")}, {r8("spearman", "spearman")}, {r8("auc", "auc")}, {r8("m1", "mean_success")}, {r8("m0", "mean_failure")}, row_number() OVER (ORDER BY abs(round(pearson, 9)) DESC, signal) AS rank FROM a""")
def signal_report(spark, d):
    return rounded(evaluate.signal_report(signals(spark, d), ["length", "kinds", "variety"], "is_correct"))


@query("best_threshold", f"""WITH {T1}, {SIGNALS}, v AS (SELECT DISTINCT length AS value FROM s0), c AS (SELECT value, 'ge' AS direction, (SELECT avg(CAST((length >= value) = is_correct AS INT)) FROM s0) AS a FROM v UNION ALL SELECT value, 'le', (SELECT avg(CAST((length <= value) = is_correct AS INT)) FROM s0) FROM v)
SELECT value, direction, {r8("a", "accuracy")} FROM c ORDER BY a DESC, value, direction LIMIT 1""")
def best_threshold(spark, d):
    return rounded(evaluate.best_threshold(signals(spark, d), "length", "is_correct"))


SCORED = f"{SIGNALS}, x AS (SELECT *, 1 / (1 + exp(-(length - 3) / 2)) AS score FROM s0)"


def scored_signals(spark, d):
    return signals(spark, d).withColumn("score", models.sigmoid((F.col("length") - 3) / 2))


@query("confusion", f"""WITH {T1}, {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.5 AND is_correct) AS tp, count(*) FILTER (score < 0.5 AND NOT is_correct) AS tn, count(*) FILTER (score >= 0.5 AND NOT is_correct) AS fp, count(*) FILTER (score < 0.5 AND is_correct) AS fn FROM x)
SELECT tp, tn, fp, fn, {r8("(tp + tn) / (tp + tn + fp + fn)", "accuracy")}, {r8("(tp / (tp + fn) + tn / (tn + fp)) / 2", "balanced_accuracy")} FROM c""")
def confusion(spark, d):
    return rounded(evaluate.confusion(scored_signals(spark, d), "score", "is_correct"))


@query("calibration_error", f"""WITH {T1}, {SCORED}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS p, avg(CAST(is_correct AS INT)) AS y FROM x GROUP BY 1) SELECT {r8("sum(n * abs(p - y)) / sum(n)", "ece")} FROM b""")
def calibration_error(spark, d):
    return rounded(evaluate.calibration_error(scored_signals(spark, d), "score", "is_correct"))


@query("question_auc", f"""WITH {T1}, {SCORED}, p AS (SELECT a.question_id, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM x a JOIN x b ON a.question_id = b.question_id AND a.is_correct AND NOT b.is_correct GROUP BY 1)
SELECT count(*) AS questions, {r8("avg(auc)", "mean_auc")}, {r8("avg(CAST(auc >= 0.5 AS INT))", "rate_half")}, {r8("avg(CAST(auc >= 0.6 AS INT))", "rate_six")} FROM p""")
def question_auc(spark, d):
    return rounded(evaluate.question_auc_summary(scored_signals(spark, d), "score", "is_correct"))


@query("score_distribution", f"""WITH {T1}, {SCORED} SELECT count(*) AS n, {r8("avg(score)", "mean")}, {r8("quantile_cont(score, 0.25)", "p25")}, {r8("quantile_cont(score, 0.5)", "p50")}, {r8("quantile_cont(score, 0.75)", "p75")}, {r8("min(score)", "min")}, {r8("max(score)", "max")}, {", ".join(f"count(*) FILTER (least(floor(score * 10), 9) = {i}) AS bin_{i}" for i in range(10))} FROM x""")
def score_distribution(spark, d):
    return rounded(corpus.distribution(scored_signals(spark, d), "score"))


@query("detection", f"""WITH {T1}, f AS (SELECT trace_id, is_correct, fr, 1 / (1 + exp(-(len(list_slice(tokens, 1, greatest(1, CAST(ceil(len(tokens) * fr) AS INT)))) - 2))) AS score FROM t, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) v(fr)),
g AS (SELECT trace_id, is_correct, min(fr) FILTER (greatest(score, 1 - score) >= 0.7) AS seen, arg_min(score >= 0.5, fr) FILTER (greatest(score, 1 - score) >= 0.7) AS says FROM f GROUP BY 1, 2)
SELECT CASE WHEN grouping(is_correct) = 1 THEN 'all' WHEN is_correct THEN 'success' ELSE 'failure' END AS subset, count(*) AS traces, count(seen) AS detected, {r8("count(seen) / count(*)", "detection_rate")}, {r8("median(seen)", "median_at")}, {r8("avg(CAST(says = is_correct AS INT))", "accuracy")} FROM g GROUP BY GROUPING SETS ((), (is_correct))""")
def detection(spark, d):
    t = event_traces(spark, d).withColumn("fraction", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))))
    scores = t.withColumn("score", models.sigmoid(F.greatest(F.lit(1), F.ceil(F.size("tokens") * F.col("fraction"))) - 2))
    return rounded(evaluate.detection(scores))


def model_deltas(spark, d):
    t = event_traces(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("question_id").cast("bigint") % 4).cast("string")))
    return within.token_deltas(t, least_questions=5, keys=("model",)).select("model", "token", "mean_delta")


MODELS = f"""t AS (SELECT *, 'm' || CAST(CAST(question_id AS BIGINT) % 4 AS VARCHAR) AS model FROM t0), {MIXED}, q AS (SELECT model, question_id, count(*) AS n, count(*) FILTER (is_correct) AS s FROM m GROUP BY ALL), h AS (SELECT model, question_id, token, count(*) AS nw, count(*) FILTER (is_correct) AS sw FROM (SELECT DISTINCT model, trace_id, question_id, is_correct, unnest(tokens) AS token FROM m) GROUP BY ALL),
p AS (SELECT *, CASE WHEN n > nw THEN sw / nw - (s - sw) / (n - nw) END AS d FROM h JOIN q USING (model, question_id)), x AS (SELECT model, token, avg(d) AS mean_delta FROM p GROUP BY 1, 2 HAVING count(*) >= 5 AND count(d) > 0)"""
T0 = T1.replace("t AS (", "t0 AS (", 1)


@query("stable_tokens", f"""WITH {T0}, {MODELS}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(mean_delta) DESC, token) AS r FROM x)
SELECT token, count(*) AS votes, string_agg(model, ',' ORDER BY model) AS models, {r8("avg(mean_delta)", "mean_delta")}, {r8("stddev_pop(mean_delta)", "std_delta")}, (SELECT count(DISTINCT model) FROM x) AS n_models, {r8("count(*) / (SELECT count(DISTINCT model) FROM x)", "vote_fraction")}, count(*) >= ceil((SELECT count(DISTINCT model) FROM x) / 2) AS stable FROM k WHERE r <= 3 GROUP BY 1""")
def stable_tokens(spark, d):
    return rounded(evaluate.stable_tokens(model_deltas(spark, d), 3))


@query("model_agreement", f"""WITH {T0}, {MODELS}, j AS (SELECT a.model AS model_a, b.model AS model_b, a.mean_delta AS a, b.mean_delta AS b FROM x a JOIN x b ON a.token = b.token AND a.model < b.model), r AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY a DESC) AS ra, rank() OVER (PARTITION BY model_a, model_b ORDER BY b DESC) AS rb FROM j)
SELECT model_a, model_b, count(*) AS common, {r8("coalesce(corr(a, b), 0)", "pearson")}, {r8("coalesce(corr(ra, rb), 0)", "spearman")}, {r8("avg(CAST(sign(a) = sign(b) AS INT))", "sign_agreement")} FROM r GROUP BY 1, 2""")
def model_agreement(spark, d):
    return rounded(evaluate.model_agreement(model_deltas(spark, d)))


def event_tokens(spark, d):
    return sorted(r.event_type for r in table(spark, d, "events").select("event_type").distinct().collect())


@query("delta_matrix", f"""WITH {T1}, {DELTAS}, e AS (SELECT DISTINCT event_type AS token FROM events), g AS (SELECT question_id, e.token, coalesce(avg(d) FILTER (p.token = e.token), 0) AS d FROM p, e WHERE p.d IS NOT NULL GROUP BY 1, 2)
SELECT question_id, string_agg(printf('%.6f', round(d, 6) + 0.0), ' ' ORDER BY token) AS deltas FROM g GROUP BY 1""")
def delta_matrix(spark, d):
    names = event_tokens(spark, d)
    rows = within.per_question(within.mixed(event_traces(spark, d)), F.col("tokens")).filter("delta_q is not null")
    m = evaluate.delta_matrix(rows, names)
    return m.select("question_id", F.concat_ws(" ", *(F.format_string("%.6f", F.round(c, 6) + F.lit(0.0)) for c in names)).alias("deltas"))


@query("clusters")
def clusters(spark, d):
    """K-means after principal components has no SQL; tests look at its partition and signatures."""
    names = event_tokens(spark, d)
    rows = within.per_question(within.mixed(event_traces(spark, d)), F.col("tokens")).filter("delta_q is not null")
    return rounded(evaluate.cluster_signatures(models.clusters(evaluate.delta_matrix(rows, names), names), names))


@query("adjusted_rand", f"""WITH {T1}, r AS (SELECT question_id, CAST(question_id AS BIGINT) % 3 AS a, count(*) % 3 AS b FROM t GROUP BY 1), c AS (SELECT a, b, count(*) AS n FROM r GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS sb, (SELECT sum(n) FROM c) AS m)
SELECT {r8("(ab - sa * sb / (m * (m - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (m * (m - 1) / 2))", "ari")} FROM s""")
def adjusted_rand(spark, d):
    rows = event_traces(spark, d).groupBy("question_id").agg((F.count(F.lit(1)) % 3).alias("b")).withColumn("a", F.col("question_id").cast("bigint") % 3)
    return rounded(evaluate.adjusted_rand(rows, "a", "b"))


@query("oracle_baseline", f"WITH {T1} SELECT trace_id, {r8('avg(CAST(is_correct AS INT)) OVER (PARTITION BY question_id)', 'score')} FROM t")
def oracle_baseline(spark, d):
    return rounded(evaluate.leave_out_rate(event_traces(spark, d)).select("trace_id", "score"))


@query("group_folds")
def group_folds(spark, d):
    """Largest group to the lightest fold: an order-dependent rule, tested against plain Python."""
    return evaluate.group_folds(spark, event_traces(spark, d))


@query("hold_out_logistic")
def hold_out_logistic(spark, d):
    """Gradient descent on held-out questions; tests hold the weights against plain numpy."""
    return rounded(models.hold_out_metrics(models.hold_out(event_traces(spark, d))))


@query("naive_bayes_scores", f"""WITH {T1}, {TOTALS}, {G12}, c AS (SELECT motif, count(*) FILTER (is_correct) AS a, count(*) FILTER (NOT is_correct) AS b FROM g GROUP BY 1 HAVING count(*) >= 12),
w AS (SELECT motif, ln((1 - (a + 1) / (s + 2)) / (1 - (b + 1) / (f + 2))) AS absent, ln(((a + 1) / (s + 2)) / ((b + 1) / (f + 2))) AS present FROM c, n),
k AS (SELECT ln((s + 1) / (f + 1)) + (SELECT sum(absent) FROM w) AS k FROM n), z AS (SELECT trace_id, sum(present - absent) AS v FROM g JOIN w USING (motif) GROUP BY 1)
SELECT trace_id, {r8("1 / (1 + exp(-(k + coalesce(v, 0))))", "score")} FROM t LEFT JOIN z USING (trace_id), k""")
def naive_bayes_scores(spark, d):
    rows = models.feature_sets(event_traces(spark, d), 1, 2)
    return rounded(models.naive_bayes(rows).score(rows).select("trace_id", "score"))


@query("bootstrap_deltas")
def bootstrap_deltas(spark, d):
    """Random by nature: tests look at its limits."""
    rows = within.per_question(within.mixed(event_traces(spark, d)), F.col("tokens"))
    return rounded(resample.bootstrap_mean(rows, "token", "delta_q", 10_000))


@query("permutation_null")
def permutation_null(spark, d):
    return rounded(resample.permutation_null(event_traces(spark, d), 500))


@query("length_permutation")
def length_permutation(spark, d):
    return rounded(resample.length_permutation(event_traces(spark, d), 5000))


ATTEMPTS = """a AS (SELECT CAST(user_id AS VARCHAR) AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt_index, event_id % 3 <> 0 AS has_clear_answer, value >= 50 AS is_correct FROM events)"""


def attempts(spark, d):
    e = table(spark, d, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("string").alias("question_id"), place.cast("long").alias("attempt_index"), (F.col("event_id") % 3 != 0).alias("has_clear_answer"), (F.col("value") >= 50).alias("is_correct"))


KEPT = "k AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY attempt_index) - 1 AS sample_id FROM a WHERE attempt_index < 20 AND has_clear_answer)"


@query("collected", f"WITH {ATTEMPTS}, {KEPT} SELECT question_id, attempt_index, sample_id, is_correct FROM k WHERE sample_id < 5")
def collected(spark, d):
    return rounded(collect.collected(attempts(spark, d), 5, 20).select("question_id", "attempt_index", "sample_id", "is_correct"))


@query("attempts_used", f"""WITH {ATTEMPTS}, {KEPT}, c AS (SELECT question_id, count(*) AS accepted, max(attempt_index) AS last FROM k WHERE sample_id < 5 GROUP BY 1), r AS (SELECT question_id, count(*) AS tried FROM a WHERE attempt_index < 20 GROUP BY 1)
SELECT question_id, coalesce(accepted, 0) AS accepted, CASE WHEN accepted >= 5 THEN last + 1 ELSE tried END AS attempts_used FROM r LEFT JOIN c USING (question_id)""")
def attempts_used(spark, d):
    return rounded(collect.attempts_used(attempts(spark, d), 5, 20))


@query("adaptive", f"""WITH {ATTEMPTS}, {KEPT}, x AS (SELECT question_id, count(*) FILTER (sample_id < 3) AS a3, count(*) FILTER (sample_id < 3 AND is_correct) AS r3, count(*) FILTER (sample_id < 3 AND NOT is_correct) AS w3, count(*) FILTER (sample_id < 8) AS a8, count(*) FILTER (sample_id < 8 AND is_correct) AS r8, count(*) FILTER (sample_id < 8 AND NOT is_correct) AS w8 FROM k GROUP BY 1),
y AS (SELECT DISTINCT a.question_id, coalesce(a3, 0) AS a3, coalesce(r3, 0) AS r3, coalesce(w3, 0) AS w3, coalesce(a8, 0) AS a8, coalesce(r8, 0) AS r8, coalesce(w8, 0) AS w8, coalesce(r3 > 0 AND w3 > 0 AND a3 < 8, false) AS d FROM a LEFT JOIN x USING (question_id))
SELECT question_id, a3 AS accepted_scout, r3 AS right_scout, w3 AS wrong_scout, CASE WHEN d THEN a8 ELSE a3 END AS accepted_final, CASE WHEN d THEN r8 ELSE r3 END AS right_final, CASE WHEN d THEN w8 ELSE w3 END AS wrong_final, d AS was_densified,
  CASE WHEN d THEN 'mixed_densified' WHEN a3 = 0 THEN 'no_accepted_traces' WHEN r3 > 0 AND w3 > 0 THEN 'mixed_target_reached' WHEN a3 < 3 AND r3 > 0 THEN 'partial_all_correct_stop' WHEN a3 < 3 AND w3 > 0 THEN 'partial_all_wrong_stop' WHEN a3 < 3 THEN 'partial_no_signal_stop' WHEN w3 = 0 THEN 'all_correct_stop' WHEN r3 = 0 THEN 'all_wrong_stop' ELSE 'scout_stop' END AS decision FROM y""")
def adaptive(spark, d):
    return rounded(collect.adaptive(attempts(spark, d), 3, 8, 20))


LOG = """g AS (SELECT CASE event_id % 7 WHEN 0 THEN 'question_started' WHEN 1 THEN 'trace_chunked' WHEN 2 THEN 'metadata_ready' WHEN 3 THEN 'trace_tokenized' WHEN 4 THEN CASE WHEN value > 95 THEN 'question_done' ELSE 'heartbeat' END WHEN 5 THEN CASE WHEN value > 98 THEN 'question_error' ELSE 'heartbeat' END ELSE 'run_started' END AS event,
  epoch(ts) + event_id / 1e9 AS ts, CAST(user_id AS VARCHAR) AS question_id, CAST(value AS BIGINT) % 5 AS count, 'e' || event_id AS error FROM events)"""


def event_log(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 7
    name = F.when(k == 0, "question_started").when(k == 1, "trace_chunked").when(k == 2, "metadata_ready").when(k == 3, "trace_tokenized").when(k == 4, F.when(F.col("value") > 95, "question_done").otherwise("heartbeat")).when(k == 5, F.when(F.col("value") > 98, "question_error").otherwise("heartbeat")).otherwise("run_started")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(name.alias("event"), (seconds + F.col("event_id") / 1e9).alias("ts"), F.col("user_id").cast("string").alias("question_id"), (F.round("value").cast("long") % 5).alias("count"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"))


STATUS = f"""{T1}, {LOG.replace("CAST(value AS BIGINT)", "CAST(round(value) AS BIGINT)")}, v AS (SELECT *, CASE event WHEN 'question_started' THEN 'started' WHEN 'trace_chunked' THEN 'chunking' WHEN 'metadata_ready' THEN 'metadata_ready' WHEN 'trace_tokenized' THEN 'tokenizing' WHEN 'question_done' THEN 'done' WHEN 'question_error' THEN 'error' END AS st FROM g WHERE question_id <> ''),
p AS (SELECT question_id, arg_max(st, ts) FILTER (st IS NOT NULL) AS stage, coalesce(max(count) FILTER (event = 'trace_chunked'), 0) AS ch, coalesce(max(count) FILTER (event = 'trace_tokenized'), 0) AS tk, bool_or(event = 'question_done') AS done, coalesce(arg_max(error, ts) FILTER (event = 'question_error'), '') AS error FROM v GROUP BY 1),
w AS (SELECT question_id, count(*) AS ex FROM t GROUP BY 1), h AS (SELECT question_id, count(*) AS wr FROM t WHERE is_correct AND CAST(question_id AS BIGINT) % 3 = 0 GROUP BY 1), md AS (SELECT DISTINCT question_id FROM t WHERE CAST(question_id AS BIGINT) % 11 = 0),
z AS (SELECT w.question_id, ex, least(ch, ex) AS ch, least(tk, ex) AS tk, coalesce(wr, 0) AS wr, coalesce(error, '') AS error, CASE WHEN coalesce(error, '') <> '' THEN 'error' WHEN done OR md.question_id IS NOT NULL OR coalesce(wr, 0) >= ex THEN 'done' WHEN tk > 0 THEN 'tokenizing' WHEN ch > 0 OR stage IN ('chunking', 'metadata_ready', 'started') THEN 'chunking' WHEN (SELECT bool_or(event = 'run_started') FROM g) THEN 'queued' ELSE 'pending' END AS status
  FROM w LEFT JOIN h USING (question_id) LEFT JOIN md ON md.question_id = w.question_id LEFT JOIN p ON p.question_id = w.question_id)"""


def run_status(spark, d):
    t = event_traces(spark, d)
    q = F.col("question_id").cast("bigint")
    return status.status(t, t.filter(F.col("is_correct") & (q % 3 == 0)), t.filter(q % 11 == 0), event_log(spark, d))


@query("run_status", f"WITH {STATUS} SELECT question_id, ex AS expected_traces, ch AS chunked_traces, tk AS tokenized_traces, wr AS written_traces, status, error FROM z")
def status_rows(spark, d):
    return rounded(run_status(spark, d).drop("updated_ts"))


@query("run_status_totals", f"WITH {STATUS} SELECT count(*) AS questions, CAST(sum(ex) AS BIGINT) AS expected_traces, CAST(sum(wr) AS BIGINT) AS written_traces, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_questions" for s in ("done", "chunking", "tokenizing", "queued", "pending", "error")) + " FROM z")
def status_totals(spark, d):
    return rounded(status.roll_up(run_status(spark, d)))


@query("unfinished", f"WITH {T1} SELECT trace_id FROM t WHERE NOT (is_correct AND len(tokens) >= 2)")
def unfinished(spark, d):
    t = event_traces(spark, d)
    return corpus.not_done(t, t.filter("is_correct and size(tokens) >= 2")).select("trace_id")


@query("typed_tokens", f"WITH {T2} SELECT trace_id, array_to_string(list_transform(tokens, lambda x: split_part(x, ':', 1)), '|') AS base, array_to_string(list_transform(list_filter(list_zip(tokens, list_prepend(NULL, tokens)), lambda z: z[1] IS NOT NULL AND z[1] IS DISTINCT FROM z[2]), lambda z: z[1]), '|') AS runs FROM t")
def typed(spark, d):
    return rounded(order_traces(spark, d).select("trace_id", base_types(F.col("tokens")).alias("base"), compressed(F.col("tokens")).alias("runs")))


@query("text_measures", r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS lines, CAST(length(text) AS BIGINT) AS chars FROM documents")
def text_measures(spark, d):
    return rounded(table(spark, d, "documents").select("doc_id", *corpus.text_measures(F.col("text"))))


@query("merged_benchmarks", r"""WITH r AS (SELECT 'a' AS source_dataset, 0 AS part, item_id AS place, text AS question, CAST(item_id AS VARCHAR) AS answer FROM benchmark UNION ALL SELECT 'b', 1, item_id, ' ' || text || '  ', 'again' FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT 'b', 1, 100000 + item_id, 'x' || text, 'new' FROM benchmark WHERE item_id % 5 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) ORDER BY part, place) AS rk FROM r)
SELECT row_number() OVER (ORDER BY part, place) - 1 AS question_id, md5(question) AS question, answer, source_dataset FROM k WHERE rk = 1""")
def merged_benchmarks(spark, d):
    b = table(spark, d, "benchmark")
    one = b.select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("answer"), F.col("item_id").alias("place"))
    again = b.filter("item_id % 2 = 0").select(F.concat(F.lit(" "), "text", F.lit("  ")).alias("question"), F.lit("again").alias("answer"), F.col("item_id").alias("place"))
    new = b.filter("item_id % 5 = 0").select(F.concat(F.lit("x"), "text").alias("question"), F.lit("new").alias("answer"), (F.col("item_id") + 100_000).alias("place"))
    return rounded(corpus.merged_benchmarks([("a", one), ("b", again.union(new))]).withColumn("question", F.md5("question")))


@query("conversation_traces", """WITH r AS (SELECT conv_id, list(role ORDER BY turn, role) AS tokens FROM conversations GROUP BY 1), x AS (SELECT array_to_string(tokens, '|') AS trace, count(*) AS n FROM r GROUP BY 1) SELECT trace, n FROM x""")
def conversation_traces(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("tokens"))
    return t.groupBy(F.array_join("tokens", "|").alias("trace")).agg(F.count(F.lit(1)).alias("n"))


@query("final_answers")
def final_answers(spark, d):
    """Markers in made answers over the documents' last words; tests hold the cascade against literals."""
    docs = table(spark, d, "documents")
    last = F.element_at(F.split(F.trim("text"), r"\s+"), -1)
    made = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("\nFINAL: "), last)).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("\n#### "), last)).when(F.col("doc_id") % 4 == 2, F.concat("text", F.lit("\n\\boxed{"), last, F.lit("}"))).otherwise(F.concat("text", F.lit("\nThe answer is "), last))
    return docs.select("doc_id", answers.final_answer(made, F.lit("final")).alias("answer"), answers.matches(last, answers.final_answer(made, F.lit("final")), F.lit("final")).alias("matches"))


@query("noise_chunks")
def noise_chunks(spark, d):
    """Chunks of documents with their types; tests hold them against plain Python."""
    docs = table(spark, d, "documents").withColumn("chunks", chunks.chunk_trace(F.col("text")))
    return docs.select("doc_id", F.size("chunks").alias("n_chunks"), chunks.normalized_trace(F.lit("MISSING"), F.col("chunks")).alias("tokens"))


@query("exact_tests", f"""WITH v AS (SELECT a, b, c, d FROM generate_series(0, 6) x(a), generate_series(0, 5) y(b), generate_series(0, 6) z(c), generate_series(0, 5) w(d)) SELECT a, b, c, d, {r8(fisher_sql("a", "b", "c", "d"), "p")} FROM v""")
def exact_tests(spark, d):
    s = lambda n, c: spark.range(n + 1).withColumnRenamed("id", c)
    v = s(6, "a").join(s(5, "b")).join(s(6, "c")).join(s(5, "d"))
    return rounded(v.withColumn("p", stats.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d"))))



LIST = "SELECT '{n}' AS list, row_number() OVER (ORDER BY {o}, motif) AS rank, motif FROM v WHERE s >= 10 QUALIFY rank <= 20"
V1 = f"{NGRAMS.format(low=2, high=4)}, {COUNTS}, v AS (SELECT motif, a + b AS s, a, b, CAST(printf('%.6f', a / (a + b)) AS DOUBLE) AS pc, CAST(printf('%.6f', b / (a + b)) AS DOUBLE) AS pi, CAST(printf('%.6f', (a + 1) / (b + 1)) AS DOUBLE) AS ec, CAST(printf('%.6f', (b + 1) / (a + 1)) AS DOUBLE) AS ei FROM c)"


@query("motif_lists", f"WITH {T1}, {V1} " + " UNION ALL ".join(LIST.format(n=n, o=o) for n, o in {"best": "pc DESC, s DESC, ec DESC", "worst": "pi DESC, s DESC, ei DESC", "most_correct_enriched": "ec DESC, s DESC", "most_incorrect_enriched": "ei DESC, s DESC", "most_frequent": "s DESC"}.items()))
def motif_lists(spark, d):
    return rounded(summaries.ranked_lists(mining.v1_motifs(event_traces(spark, d))))


@query("motif_dominance", f"""WITH {T1}, {V1} SELECT count(*) FILTER (a > b) AS correct_dominant, count(*) FILTER (b > a) AS incorrect_dominant, count(*) FILTER (a = b) AS tie_dominant, {r8("min(pc)", "min")}, {r8("quantile_cont(pc, 0.25)", "p25")}, {r8("median(pc)", "median")}, {r8("avg(pc)", "mean")}, {r8("quantile_cont(pc, 0.75)", "p75")}, {r8("max(pc)", "max")} FROM v""")
def motif_dominance(spark, d):
    return rounded(summaries.dominance(mining.v1_motifs(event_traces(spark, d))))


@query("dataset_summary", f"""WITH {T2} SELECT count(*) AS trace_count, count(DISTINCT question_id) AS question_count, count(*) FILTER (is_correct) AS success_count, count(*) FILTER (NOT is_correct) AS failure_count, {r8("avg(len(tokens))", "avg_token_count")}, {r8("median(len(tokens))", "median_token_count")}, max(len(tokens)) AS max_token_count,
  0::BIGINT AS rows_with_noise, 0::DOUBLE AS rows_with_noise_rate, (SELECT count(DISTINCT x) FROM (SELECT unnest(tokens) AS x FROM t)) AS unique_token_count FROM t""")
def dataset_summary(spark, d):
    return rounded(summaries.dataset_summary(order_traces(spark, d)))


@query("token_types", f"WITH {T2} SELECT split_part(x, ':', 1) AS token_type, count(*) AS count FROM (SELECT unnest(tokens) AS x FROM t) GROUP BY 1")
def token_types(spark, d):
    return rounded(summaries.type_counts(order_traces(spark, d)))


@query("base_type_scores", f"WITH {T0}, {MODELS} SELECT model, split_part(token, '_', 1) AS key, {r8('avg(mean_delta)', 'score')} FROM x GROUP BY 1, 2")
def base_type_scores(spark, d):
    return rounded(summaries.key_means(model_deltas(spark, d), F.substring_index("token", "_", 1), by=("model",)))


@query("class_lengths", f"""WITH {T1} SELECT question_id, {r8("coalesce(sum(len(tokens)) FILTER (is_correct), 0) / greatest(count(*) FILTER (is_correct), 1)", "success_avg_length")}, {r8("coalesce(sum(len(tokens)) FILTER (NOT is_correct), 0) / greatest(count(*) FILTER (NOT is_correct), 1)", "failure_avg_length")} FROM t GROUP BY 1""")
def class_lengths(spark, d):
    return rounded(summaries.class_lengths(event_traces(spark, d)))


@query("from_question", f"WITH {T1}, m AS (SELECT max(CAST(question_id AS BIGINT)) // 2 AS k FROM t), b AS (SELECT min(CAST(question_id AS BIGINT)) AS k FROM t WHERE CAST(question_id AS BIGINT) >= (SELECT k FROM m)) SELECT trace_id FROM t, b WHERE CAST(question_id AS BIGINT) >= b.k")
def from_question(spark, d):
    t = event_traces(spark, d)
    q = F.col("question_id").cast("long")
    half = t.agg(F.max(q)).first()[0] // 2
    return summaries.from_question(t, str(t.filter(q >= half).agg(F.min(q)).first()[0])).select("trace_id")


@query("matched_motifs", f"""WITH {T1}, {SEP}, h AS (SELECT g.trace_id, y.direction, y.rank, y.motif FROM g JOIN y ON g.question_id = y.question_id AND g.motif = y.motif WHERE rank <= 8)
SELECT t.trace_id, coalesce(string_agg(motif, ',' ORDER BY rank) FILTER (direction = 'success'), '') AS matched_success, coalesce(string_agg(motif, ',' ORDER BY rank) FILTER (direction = 'failure'), '') AS matched_failure FROM t LEFT JOIN h USING (trace_id) GROUP BY 1""")
def matched_motifs(spark, d):
    t = event_traces(spark, d)
    found = summaries.matched_motifs(t, export.split_by_direction(export.local_rows(t)))
    return found.select("trace_id", F.array_join("matched_success_motifs", ",").alias("matched_success"), F.array_join("matched_failure_motifs", ",").alias("matched_failure"))


@query("auc_trajectory", f"""WITH {T1}, p AS (SELECT question_id, fr AS fraction, avg(CASE WHEN is_correct THEN greatest(1, ceil(len(tokens) * fr)) ELSE -1 END) AS v FROM t, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) f(fr) GROUP BY 1, 2),
s AS (SELECT *, lag(v) OVER (PARTITION BY question_id ORDER BY fraction) AS last FROM p) SELECT question_id, {r8("regr_slope(v, fraction)", "slope")}, NOT coalesce(bool_or(last > v + 1e-12), false) AS monotonic_non_decreasing FROM s GROUP BY 1""")
def auc_trajectory(spark, d):
    t = event_traces(spark, d).withColumn("fraction", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75, 1.0)))))
    v = F.when(F.col("is_correct"), F.greatest(F.lit(1), F.ceil(F.size("tokens") * F.col("fraction")))).otherwise(F.lit(-1))
    return rounded(signal.trajectory(t.groupBy("question_id", "fraction").agg(F.avg(v).alias("v")), "fraction", "v", ("question_id",)))


METRICS = f"""{SIGNALS}, u AS (SELECT unnest(['length', 'kinds', 'variety']) AS signal, unnest([length, kinds, variety]) AS x, is_correct FROM s0),
mt AS (SELECT signal, corr(x, CAST(is_correct AS INT)) AS p, avg(x) FILTER (is_correct) AS m1, avg(x) FILTER (NOT is_correct) AS m0 FROM u GROUP BY 1), st AS (SELECT *, CASE WHEN abs(m1 - m0) < 1e-9 THEN 1 ELSE abs(m1 - m0) END AS scale, (m1 + m0) / 2 AS th FROM mt),
w AS (SELECT trace_id, is_correct, sum(p * (x - th) / scale) AS raw FROM (SELECT trace_id, is_correct, unnest(['length', 'kinds', 'variety']) AS signal, unnest([length, kinds, variety]) AS x FROM s0) JOIN st USING (signal) GROUP BY 1, 2)"""


def predictions(spark, d):
    rows = signals(spark, d)
    names = ["length", "kinds", "variety"]
    report = evaluate.signal_report(rows, names, "is_correct").select("signal", F.col("rank").alias("place"), F.col("pearson").alias("pearson_with_correct"), F.col("mean_success").alias("mean_correct"), F.col("mean_failure").alias("mean_incorrect"), ((F.col("mean_success") + F.col("mean_failure")) / 2).alias("best_threshold"))
    return signal.success_scores(rows, report)


@query("success_scores", f"WITH {T1}, {METRICS} SELECT trace_id, {r8('raw', 'raw_score')}, {r8('1 / (1 + exp(-raw))', 'p_success')}, 1 / (1 + exp(-raw)) >= 0.5 AS predicted FROM w")
def success_scores(spark, d):
    return rounded(predictions(spark, d).select("trace_id", "raw_score", "p_success", "predicted"))


@query("prediction_summary", f"WITH {T1}, {METRICS} SELECT count(*) AS rows, {r8('avg(CAST((1 / (1 + exp(-raw)) >= 0.5) = is_correct AS INT))', 'accuracy')}, {r8('avg(round(1 / (1 + exp(-raw)), 6))', 'mean_p_success')} FROM w")
def prediction_summary(spark, d):
    return rounded(signal.prediction_summary(predictions(spark, d)))


@query("signal_metrics")
def signal_metrics(spark, d):
    """Six signals of critical steps with their best thresholds; parts of it have SQL (signal_report, best_threshold)."""
    t = Scratch(spark).write(event_traces(spark, d).select("trace_id", "tokens", "is_correct"), "traces")
    return rounded(signal.metrics(signal.signal_columns(mining.critical_steps(t, mining.motif_index(mining.v1_motifs(t)), 2, 4, strings=False).join(t.select("trace_id", "tokens"), "trace_id"))))


@query("normalized_benchmark", "SELECT row_number() OVER (ORDER BY item_id) - 1 AS question_id, trim(text) AS question, CAST(item_id % 7 AS VARCHAR) AS answer, 'b' AS source_dataset, CAST(item_id AS VARCHAR) AS source_id, 'easy' AS level FROM benchmark WHERE item_id % 7 <> 3 AND trim(text) <> ''")
def normalized_benchmark(spark, d):
    b = table(spark, d, "benchmark")
    rows = b.select(F.col("text").alias("problem"), F.when(F.col("item_id") % 7 == 3, F.lit(" ")).otherwise((F.col("item_id") % 7).cast("string")).alias("answer"), F.col("item_id").alias("id"))
    return rounded(tables.normalized_benchmark(rows, "b", level="easy", order="id"))


WORDS = {k: v.replace("'", "''") for k, v in export.SENTENCES.items()}
INSIGHTS = f"""i AS (SELECT question_id, CASE WHEN s > 0 AND n > s THEN printf('{WORDS["mixed"]}', s, n - s) WHEN s > 0 THEN '{WORDS["right"]}' ELSE '{WORDS["wrong"]}' END AS mood,
  CASE WHEN ms < mf THEN '{WORDS["shorter"]}' WHEN ms > mf THEN '{WORDS["longer"]}' WHEN ms = mf THEN '{WORDS["even"]}' END AS size, CASE WHEN s >= 2 AND n - s >= 2 THEN printf('{WORDS["up"]}', up) END AS su, CASE WHEN s >= 2 AND n - s >= 2 THEN printf('{WORDS["down"]}', down) END AS sd,
  CASE WHEN da >= 3 THEN printf('{WORDS["spread"]}', da) END AS spread FROM (SELECT question_id, count(*) AS n, count(*) FILTER (is_correct) AS s, median(len(tokens)) FILTER (is_correct) AS ms, median(len(tokens)) FILTER (NOT is_correct) AS mf, count(DISTINCT predicted_answer) AS da FROM t GROUP BY 1)
  LEFT JOIN (SELECT question_id, max(motif) FILTER (rank = 1 AND direction = 'success') AS up, max(motif) FILTER (rank = 1 AND direction = 'failure') AS down FROM y GROUP BY 1) USING (question_id))"""


@query("question_insights", f"WITH {T1}, {SEP}, {INSIGHTS} SELECT question_id, array_to_string(list_slice(list_filter([mood, size, su, sd, spread], lambda x: x IS NOT NULL), 1, 4), ' | ') AS insights FROM i")
def question_insights(spark, d):
    return export.question_summaries(event_traces(spark, d)).select("question_id", F.array_join("insights", " | ").alias("insights"))


@query("lift_bootstrap")
def lift_bootstrap(spark, d):
    """Random by nature: tests look at its limits."""
    rows = within.position_deltas(event_traces(spark, d))
    return rounded(resample.bootstrap_lifts(rows.groupBy("base").agg(F.max("lift_ratio").alias("lift_ratio"), F.max(F.abs("mean_delta")).alias("max_position_abs"), F.max(F.abs("collapsed_delta")).alias("collapsed_abs")).withColumnRenamed("base", "token")))


@query("cluster_stability")
def cluster_stability(spark, d):
    """Resampled k-means: tests look at its limits."""
    names = event_tokens(spark, d)
    rows = within.per_question(within.mixed(event_traces(spark, d)), F.col("tokens")).filter("delta_q is not null")
    return rounded(resample.cluster_stability(evaluate.delta_matrix(rows, names), names, lambda m, t, seed: models.clusters(m, t, seed=seed)))
