"""Host-level quality rules, in DataFrame and SQL functions only.

``measure`` adds the per-document figures and ``base_failed``. ``judge`` sums the
failures by host, shrinks each host's failure rate towards an empirical beta prior
(fitted to all hosts by moments) and joins the hosts' verdicts back: a document is
kept unless it failed itself or its host's shrunk rate is above ``host_limit``.

Measured rows are written once to the shared folder, so that texts are measured
once for both uses. Sums by host combine in the tasks that measured, so a host with
a third of all rows costs one row per task; the verdicts are broadcast only when
their counted number is small and joined by Spark's skew-aware join otherwise.

Defined results: a null text has no words (and so fails); a null host has no
verdict of its own and rejects nothing; an empty table gives no rows; other columns
pass through, but for those that bear the name of an added one, which are replaced; very
long texts are measured whole; repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenark.llm.common import cut, others, unused

#: Hosts up to which the verdicts may be broadcast (a few bytes each).
BROADCAST_HOSTS = 50_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_SPACES = r"' \t\n\u000b\u000c\r'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once under ``name`` within ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words(words: str) -> str:
    """Words covered by windows that occur twice or more, the first included.
    Windows are hashed; only a text with a repeated window sorts them."""
    window = ", ".join(f"wh[i + {k}]" for k in range(WINDOW))
    repeated = "filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k < size(s) - 1 AND s[k + 1].h = x.h))"
    covered = f"aggregate(transform(p, (q, k) -> IF(k = size(p) - 1, {WINDOW}, least({WINDOW}, p[k + 1] - q))), 0L, (a, b) -> a + b)"
    positions = _let(f"sort_array(transform({repeated}, x -> x.i))", "p", covered)
    slow = _let("sort_array(transform(hs, (h, i) -> struct(h AS h, i AS i)))", "s", positions)
    windows = f"transform(sequence(0, size(wh) - {WINDOW}), i -> xxhash64({window}))"
    body = _let(windows, "hs", f"IF(size(array_distinct(hs)) = size(hs), 0L, {slow})")
    return f"IF(size({words}) <= {WINDOW}, 0L, {_let(f'transform({words}, w -> xxhash64(w))', 'wh', body)})"


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and base_failed."""
    text = f"coalesce(`{text_col}`, '')"
    lines = f"filter(split({text}, '\\n', -1), l -> translate(l, {_SPACES}, '') <> '')"
    figures = _let(
        rf"array_remove(split({text}, '[\\x20\\x09-\\x0D]+', -1), '')",
        "ws",
        f"""named_struct(
          'n_words', bigint(size(ws)),
          'word_chars', bigint(char_length(translate({text}, {_SPACES}, ''))),
          'n_symbols', bigint(char_length({text}) - char_length(translate({text}, '#*$%&|<>', ''))),
          'n_dup_lines', IF(instr({text}, '\\n') = 0, 0L, {_let(lines, "ls", "bigint(size(ls) - size(array_distinct(ls)))")}),
          'n_repeat_words', {_repeat_words("ws")})""",
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    held = unused(docs.columns, "_figures")
    out = docs.withColumn(held, F.expr(figures))
    out = out.withColumns({n: F.col(f"`{held}`.{n}") for n in names}).drop(held)
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, host_col: str = "source", host_limit: float = 0.5) -> DataFrame:
    """One row per host: n, failures, shrunk_rate and host_failed.

    The prior's mean m is the overall rate; its strength s follows from the
    variance v that the hosts' rates show beyond binomial sampling:
    s = m (1 - m) / v - 1, kept between 2 and 10000 rows' worth."""
    hosts = measured.where(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = cut(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("hosts")).first()
    if not total["n"]:
        return hosts.withColumns({"shrunk_rate": F.lit(0.0), "host_failed": F.lit(False)})
    m = total["f"] / total["n"]
    spread = hosts.agg(F.sum(F.col("n") * F.pow(F.col("failures") / F.col("n") - m, 2)).alias("v")).first()["v"] / total["n"]
    noise = m * (1 - m) * total["hosts"] / total["n"]
    between = spread - noise
    strength = min(max(m * (1 - m) / between - 1, 2.0), 10_000.0) if between > 0 else 10_000.0
    rate = (F.col("failures") + m * strength) / (F.col("n") + strength)
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_failed", rate > host_limit)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with the figures,
    base_failed, shrunk_rate and kept."""
    names = others(docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "shrunk_rate", "kept")
    measured = measure(docs.select(*names), text_col)
    measured = cut(measured if keep_text else measured.drop(text_col), "measured")
    host, failed = (unused(measured.columns, n) for n in ("_host", "_host_failed"))
    hosts = host_verdicts(measured, host_col, host_limit).select(F.col("host").alias(host), "shrunk_rate", F.col("host_failed").alias(failed))
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    joined = measured.join(hosts, measured[host_col] == F.col(host), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(failed, F.lit(False))).drop(host, failed)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w)),
r AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT g.doc_id, g.i + k AS p FROM g JOIN r USING (doc_id, g), range(0, 8) t(k)) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(f) / sum(n) AS m, count(*) / sum(n) AS per, sum(n) AS n FROM h),
v AS (SELECT any_value(p.m) AS m, sum(h.n * pow(h.f / h.n - p.m, 2)) / any_value(p.n) - any_value(p.m * (1 - p.m) * p.per) AS v FROM h, p),
s AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 10000.0) ELSE 10000.0 END AS s FROM v),
j AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT coalesce(host_failed, false)) AS kept
FROM b LEFT JOIN j USING (source)
"""
