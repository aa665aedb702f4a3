"""Ranked retrieval, from lanes to answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenark.functions import text as T
from lumenark.operators import fusion, keyword, lexical, present, vector
from lumenark.operators import graph as G
from lumenark.operators import search as S
from lumenark.operators.search import Options, shortlist
from lumenark.plans.registry import query

COLUMNS = {"text": 1.0, "heading_path": 1.0}


def _words(v, n=4):
    """The first words of the first conversation turn, as the question."""
    row = v.table("conversations").where("length(text) > 60").orderBy("conv_id", "turn").select("text").first()
    return " ".join(row["text"].split()[:n])


def _vector(v):
    return list(v.vectors.orderBy("seq").first()["vector"])


_Q = r""", qt AS (SELECT text FROM conversations WHERE length(text) > 60 ORDER BY conv_id, turn LIMIT 1),
qw AS (SELECT DISTINCT regexp_replace(lower(w), '[^\p{L}\p{N}]', '', 'g') AS term FROM (SELECT unnest(([x FOR x IN string_split_regex(text, '\s+') IF x <> ''])[1:4]) AS w FROM qt) WHERE regexp_matches(w, '[\p{L}\p{N}]')),
tk AS (SELECT file_id, seq, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] || [x FOR x IN string_split_regex(lower(coalesce(heading_path, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS t FROM chunks),
fq AS (SELECT file_id, seq, len(t) AS dl, term, len([x FOR x IN t IF x = term])::DOUBLE AS f FROM tk, qw),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tk),
df AS (SELECT term, count(*) FILTER (f > 0)::DOUBLE AS df FROM fq GROUP BY term),
id AS (SELECT term, df, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM df, st),
bm AS (SELECT file_id, seq, sum(CASE WHEN f > 0 THEN idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS bm25, sum(idf) * 2.2 AS bound FROM fq JOIN id USING (term), st GROUP BY file_id, seq HAVING sum(f) > 0),
bl AS (SELECT *, least(greatest(CASE WHEN bound <= 0 THEN 0 ELSE bm25 / bound END, 0), 1) AS bm25n FROM bm ORDER BY bm25 DESC, file_id, seq LIMIT 60),
qv AS (SELECT vector::DOUBLE[] AS q FROM vectors ORDER BY seq LIMIT 1),
cs AS (SELECT file_id, seq, list_dot_product(vector::DOUBLE[], q) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS score FROM vectors, qv),
kn AS (SELECT * FROM cs ORDER BY score DESC, file_id, seq LIMIT 60)
"""


@query(_Q + "SELECT file_id, seq, round(score, 6) AS score FROM kn")
def knn_cosine(v):
    """Exact cosine top 60."""
    return vector.knn(v.vectors, _vector(v)).withColumn("score", F.round("score", 6))


@query(_Q + ", sc AS (SELECT * FROM cs WHERE file_id IN (1, 2) ORDER BY score DESC, file_id, seq LIMIT 10) SELECT file_id, seq, round(score, 6) AS score FROM sc")
def knn_scoped(v):
    """The scope is applied before the limit."""
    return vector.knn(v.vectors.where(F.col("file_id").isin(1, 2)), _vector(v), 10).withColumn("score", F.round("score", 6))


@query(_Q + "SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM id")
def document_frequency(v):
    """R2, R5, R6."""
    terms = [lexical.sub_terms(t)[0] for t in lexical.query_terms(_words(v))]
    chunks = v.chunks.select(F.concat_ws(" ", "text", "heading_path").alias("text"))
    n = chunks.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    return lexical.document_frequency(chunks, terms).withColumn("k", F.lit(1)).join(n, "k").select("term", "df", F.round(lexical.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(_Q + "SELECT file_id, seq, round(bm25, 6) AS bm25, round(bm25n, 6) AS bm25n FROM bl")
def bm25_lane(v):
    """Any-term BM25 over text and headings, from stored postings."""
    found = keyword.bm25(v.keyword, _words(v), COLUMNS).orderBy(F.desc("bm25"), "file_id", "seq").limit(60)
    return found.select("file_id", "seq", F.round("bm25", 6).alias("bm25"), F.round(lexical.normalized(F.col("bm25"), F.col("bound")), 6).alias("bm25n"))


@query(_Q.replace(r"|| [x FOR x IN string_split_regex(lower(coalesce(heading_path, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS t", "AS t").replace("AS f FROM tk, qw", "* 2.0 AS f FROM tk, qw") + "SELECT file_id, seq, round(bm25, 6) AS bm25, round(bm25n, 6) AS bm25n FROM bl")
def bm25_one_column(v):
    """The stored index asked for one of its columns: the other adds neither hits
    nor length."""
    found = keyword.bm25(v.keyword, _words(v), {"text": 2.0}).orderBy(F.desc("bm25"), "file_id", "seq").limit(60)
    return found.select("file_id", "seq", F.round("bm25", 6).alias("bm25"), F.round(lexical.normalized(F.col("bm25"), F.col("bound")), 6).alias("bm25n"))


@query(r""", tk AS (SELECT file_id, seq, 0 AS field, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS t FROM chunks UNION ALL SELECT file_id, seq, 1, [x FOR x IN string_split_regex(lower(coalesce(heading_path, '')), '[^\p{L}\p{N}]+') IF x <> ''] FROM chunks),
w AS (SELECT file_id, seq, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM tk)
SELECT term, field, count(DISTINCT (file_id, seq))::BIGINT AS chunks, count(*)::BIGINT AS places, sum(pos)::BIGINT AS place_sum, max(pos)::BIGINT AS last_place FROM w GROUP BY term, field""")
def keyword_postings(v):
    """The whole stored index, a row for each term and field: the chunks that hold
    it and the places where it stands."""
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = v.keyword.postings.select("term", F.col("field").cast("int").alias("field"), F.size("positions").alias("n"), total.alias("sum"), F.array_max("positions").cast("long").alias("last"))
    return rows.groupBy("term", "field").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("places"), F.sum("sum").alias("place_sum"), F.max("last").alias("last_place"))


_PAIR = r""", tk AS (SELECT file_id, seq, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') IF x <> ''] AS t FROM chunks),
fw AS (SELECT t[1] AS a, t[2] AS b FROM tk WHERE len(t) > 9 ORDER BY file_id, seq LIMIT 1)"""


@query(_PAIR + ", h AS (SELECT file_id, seq, len([i FOR i IN range(1, len(t)) IF t[i] = a AND t[i + 1] = b])::BIGINT AS hits FROM tk, fw) SELECT * FROM h WHERE hits > 0")
def phrase_stored(v):
    """A phrase by the positions of its words, no text read."""
    return keyword.phrase(v.keyword, " ".join(_pair(v)), ("text",)).select("file_id", "seq", F.col("hits").cast("long").alias("hits"))


def _pair(v):
    toks = lexical.tokens(F.col("text"))
    return v.chunks.where(F.size(toks) > 9).orderBy("file_id", "seq").select(toks.alias("t")).first()["t"][:2]


@query(_PAIR + r""", pc AS (SELECT file_id, seq, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+[^\p{L}\p{N}]*') AS p FROM chunks),
pl AS (SELECT file_id, seq, p, [regexp_extract(lower(x), '^[\p{L}\p{N}]+') FOR x IN p] AS w FROM pc),
ht AS (SELECT pl.*, [i FOR i IN range(0, len(w)) IF w[i + 1] = a OR w[i + 1] = b] AS hs FROM pl, fw),
cd AS (SELECT file_id, seq, first, [i FOR i IN hs IF i >= first AND i < first + 12] AS ins, w FROM (SELECT *, unnest(hs) AS first FROM ht)),
bs AS (SELECT file_id, seq, first, ins[len(ins)] AS last FROM cd QUALIFY row_number() OVER (PARTITION BY file_id, seq ORDER BY len(list_distinct([w[i + 1] FOR i IN ins])) DESC, len(ins) DESC, first) = 1),
st AS (SELECT ht.*, greatest(least(first - (12 - (last - first + 1)) // 2, len(p) - 12), 0) AS s FROM ht JOIN bs USING (file_id, seq))
SELECT file_id, seq, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string([CASE WHEN list_contains(hs, i) THEN '<b>' || regexp_extract(p[i + 1], '^[\p{L}\p{N}]+') || '</b>' || substr(p[i + 1], length(regexp_extract(p[i + 1], '^[\p{L}\p{N}]+')) + 1) ELSE p[i + 1] END FOR i IN range(s, least(s + 12, len(p)))], '') || CASE WHEN s + 12 < len(p) THEN '...' ELSE '' END AS snippet FROM st""")
def search_snippets(v):
    """Twelve words of each chunk that holds either of two words, around the best hits."""
    words = " ".join(_pair(v))
    found = keyword.matches(v.keyword, words, {"text": 1.0})[0].select("file_id", "seq")
    return v.chunks.join(found, ["file_id", "seq"], "left_semi").select("file_id", "seq", keyword.snippet(F.col("text"), words, size=12).alias("snippet"))


@query(_Q + ", ph AS (SELECT string_agg(regexp_replace(lower(w), '[^\\p{L}\\p{N}]', '', 'g'), ' ' ORDER BY i) AS p FROM (SELECT unnest(string_split_regex(text, '\\s+')[1:2]) AS w, unnest([1, 2]) AS i FROM qt)) SELECT file_id, seq FROM tk, ph WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' ' || p || ' ')".replace("\\\\", "\\"))
def phrase_match(v):
    """Words next to each other."""
    phrase = [x for w in _words(v, 2).split() for x in lexical.sub_terms(w)]
    both = v.chunks.withColumn("t", F.concat(lexical.tokens(F.col("text")), lexical.tokens(F.col("heading_path"))))
    return both.where(lexical.phrase_hits(F.col("t"), phrase) > 0).select("file_id", "seq")


@query(_Q + "SELECT file_id, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, seq) AS r FROM kn) WHERE r <= 3")
def lane_collapse(v):
    """Three chunks per file."""
    return fusion.collapse(vector.knn(v.vectors, _vector(v)), 3).withColumn("score", F.round("score", 6))


@query(_Q + "SELECT file_id, seq, round(0.1 + 0.9 * (score - (SELECT min(score) FROM kn)) / ((SELECT max(score) FROM kn) - (SELECT min(score) FROM kn)), 6) AS norm FROM kn")
def lane_normalise(v):
    """R10."""
    return fusion.normalise(vector.knn(v.vectors, _vector(v))).select("file_id", "seq", F.round("norm", 6).alias("norm"))


_SEEDS = """, k1 AS (SELECT file_id, seq, CASE WHEN max(score) OVER () > min(score) OVER () THEN 0.1 + 0.9 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS score, 0 AS lane FROM kn),
b1 AS (SELECT file_id, seq, CASE WHEN max(bm25) OVER () > min(bm25) OVER () THEN 0.1 + 0.9 * (bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()) ELSE 1.0 END AS score, 1 AS lane FROM bl),
sd AS (SELECT file_id, seq, score, lane FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, lane, seq) AS r FROM (SELECT * FROM k1 UNION ALL SELECT * FROM b1)) WHERE r = 1) """


def _two_lanes(v):
    a = vector.knn(v.vectors, _vector(v)).select("file_id", "seq", "score")
    b = keyword.bm25(v.keyword, _words(v), COLUMNS).orderBy(F.desc("bm25"), "file_id", "seq").limit(60).select("file_id", "seq", F.col("bm25").alias("score"))
    return a, b


@query(_Q + _SEEDS + "SELECT file_id, seq, round(score, 6) AS score, lane FROM sd")
def merge_seeds(v):
    """The best normalised score of each file."""
    return fusion.seeds(list(_two_lanes(v))).withColumn("score", F.round("score", 6))


@query(_Q + _SEEDS + ", dt AS (SELECT file_id FROM notes WHERE note_date BETWEEN 1704067200 AND 1704499200) SELECT file_id, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, d, seq) AS r FROM (SELECT file_id, seq, score, 0 AS d FROM sd UNION ALL SELECT file_id, 0, 1.0, 1 FROM dt)) WHERE r = 1")
def temporal_seeds(v):
    """Notes in the date range."""
    dated = v.notes.where(F.col("note_date").between(1704067200, 1704499200))
    return fusion.with_temporal_seeds(fusion.seeds(list(_two_lanes(v))), dated).withColumn("score", F.round("score", 6))


_RRF = """, ra AS (SELECT file_id, seq, 'semantic' AS lane, row_number() OVER (ORDER BY score DESC, file_id, seq) AS r FROM kn UNION ALL SELECT file_id, seq, 'fts', row_number() OVER (ORDER BY bm25 DESC, file_id, seq) FROM bl),
rf AS (SELECT file_id, seq, sum(1.0 / (60 + r)) AS rrf, min(r) AS best_rank, string_agg(lane, ',' ORDER BY lane) AS lanes FROM ra GROUP BY file_id, seq) """


@query(_Q + _RRF + "SELECT file_id, seq, round(rrf, 8) AS rrf, best_rank, lanes, round(rrf * 100 / (SELECT max(rrf) FROM rf), 4) AS confidence FROM rf")
def rrf_fuse(v):
    """Reciprocal rank fusion with the lanes that found each chunk."""
    a, b = _two_lanes(v)
    f = fusion.rrf({"semantic": (a, 1.0), "fts": (b, 1.0)})
    return f.select("file_id", "seq", F.round("rrf", 8).alias("rrf"), F.col("best_rank").cast("long").alias("best_rank"), F.array_join("lanes", ",").alias("lanes"), F.round("confidence", 4).alias("confidence"))


@query(_Q + _RRF + "SELECT file_id, seq, round(rrf, 8) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY rrf DESC, seq) AS r FROM rf) WHERE r <= 2")
def cap_per_file(v):
    """Two chunks per file."""
    a, b = _two_lanes(v)
    f = fusion.rrf({"semantic": (a, 1.0), "fts": (b, 1.0)})
    return fusion.cap_per_file(f, 2, [F.desc("rrf"), F.asc("seq")]).select("file_id", "seq", F.round("rrf", 8).alias("rrf"))


@query(_Q + _RRF + """, p3 AS (SELECT file_id, seq, 1.0 / 60 + 0.8 / (60 + r) AS x FROM ra),
lg AS (SELECT file_id, seq, lane, r FROM ra UNION ALL SELECT file_id, seq, 'temporal', row_number() OVER (ORDER BY seq DESC, file_id) FROM rf)
SELECT file_id, seq, round(sum(CASE lane WHEN 'semantic' THEN 1.0 WHEN 'fts' THEN 0.8 ELSE 0.0 END / (60 + r)), 8) AS rrf FROM lg GROUP BY file_id, seq""")
def rrf_weighted_lanes(v):
    """Unequal lane weights, a lane of weight 0 among them."""
    a, b = _two_lanes(v)
    third = a.unionByName(b).select("file_id", "seq").distinct().withColumn("score", F.col("seq").cast("double"))
    f = fusion.rrf({"semantic": (a, 1.0), "fts": (b, 0.8), "temporal": (third, 0.0)})
    return f.select("file_id", "seq", F.round("rrf", 8).alias("rrf"))


_PPR = """, ck AS (SELECT p_partkey + 1000000000 AS file_id, unnest(range(0, p_partkey % 3 + 1))::BIGINT AS seq FROM part),
fr AS (SELECT o_orderkey AS file_id, 1::BIGINT AS seq, 1.0 / row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS mass FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
bw AS (SELECT from_file AS file_id, from_chunk_seq AS near, to_file AS far, to_chunk_seq AS fseq FROM edges UNION ALL SELECT to_file, to_chunk_seq, from_file, from_chunk_seq FROM edges),
tc AS (SELECT b.*, f.seq, f.mass, CASE WHEN near = f.seq OR near = -1 THEN 1.0 ELSE 0.5 END AS w FROM bw b JOIN fr f USING (file_id) WHERE far <> file_id),
sn AS (SELECT far, fseq, mass * w / sum(w) OVER (PARTITION BY file_id, seq) AS sent FROM tc),
nk AS (SELECT file_id, count(*) AS n FROM ck GROUP BY 1),
ms AS (SELECT far AS file_id, fseq AS seq, sent FROM sn WHERE fseq <> -1 UNION ALL SELECT ck.file_id, ck.seq, sent / sqrt(n) FROM sn JOIN ck ON ck.file_id = far JOIN nk ON nk.file_id = far WHERE fseq = -1),
pr AS (SELECT file_id, seq, sum(sent) * 0.6 AS score FROM ms GROUP BY ALL) """


def _ppr(v):
    seeds = v.table("orders").select(F.col("o_orderkey").alias("file_id"), "o_totalprice").orderBy(F.desc("o_totalprice"), "file_id").limit(20)
    rank = F.row_number().over(fusion.W.partitionBy(F.lit(0)).orderBy(F.desc("o_totalprice"), "file_id"))
    seeds = seeds.select("file_id", F.lit(1).cast("long").alias("seq"), (1.0 / rank).alias("score"))
    chunks = v.table("part").select((F.col("p_partkey") + 1_000_000_000).alias("file_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p_partkey") % 3)).alias("seq"))
    return seeds, chunks


@query(_PPR + "SELECT file_id, seq, round(score, 6) AS score FROM pr")
def ppr_hop(v):
    """One hop of personalised PageRank."""
    seeds, chunks = _ppr(v)
    return G.expand(seeds, v.edges, chunks, G.Walk(limit=1_000_000, cap=0)).withColumn("score", F.round("score", 6))


@query(_PPR + "SELECT file_id, seq, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 9) DESC, seq) AS r FROM pr) WHERE r <= 1 ORDER BY round(score, 9) DESC, file_id, seq LIMIT 20")
def ppr_capped(v):
    """One chunk per file, twenty in all (scores rounded to 9 places first)."""
    seeds, chunks = _ppr(v)
    all_ = G.expand(seeds, v.edges, chunks, G.Walk(limit=1_000_000, cap=0)).withColumn("score", F.round("score", 9))
    return fusion.collapse(all_, 1).orderBy(F.desc("score"), "file_id", "seq").limit(20).withColumn("score", F.round("score", 6))


@query("SELECT file_id, round(CASE WHEN note_date BETWEEN 1706745600 AND 1707350400 THEN 1.0 ELSE 1.0 / (1 + 0.1 * (CASE WHEN note_date < 1706745600 THEN 1706745600 - note_date ELSE note_date - 1707350400 END / 86400.0)) END, 6) AS score FROM notes")
def temporal_score(v):
    """R18."""
    return v.notes.select("file_id", F.round(T.temporal_score(F.col("note_date"), 1706745600, 1707350400), 6).alias("score"))


@query("SELECT file_id, row_number() OVER (ORDER BY note_date DESC, file_id) AS rank FROM notes WHERE note_date <= 1706745600 ORDER BY rank LIMIT 12")
def temporal_promotions(v):
    """Dated candidates, nearest to the range first."""
    end = 1706745600
    scored = v.notes.where(F.col("note_date") <= end).withColumn("score", T.temporal_score(F.col("note_date"), end, end))
    rank = F.row_number().over(fusion.W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "file_id"))
    return scored.orderBy(F.desc("score"), "file_id").limit(12).select("file_id", rank.cast("long").alias("rank"))


@query(_Q + _RRF + """, ct AS (SELECT file_id, seq, row_number() OVER (ORDER BY rrf DESC, file_id, seq) AS rank FROM rf),
gr AS (SELECT file_id, seq, 21 - rank AS rank FROM ct WHERE rank BETWEEN 1 AND 20), x AS (SELECT file_id, seq FROM ct WHERE rank <= 24),
gq AS (SELECT file_id, seq, row_number() OVER (ORDER BY rank) AS n FROM gr WHERE (file_id, seq) NOT IN (SELECT (file_id, seq) FROM x)),
tr AS (SELECT file_id, seq, 0 AS tier, rank FROM ct WHERE rank <= 24 UNION ALL SELECT file_id, seq, 1, n FROM gq WHERE n <= 8 UNION ALL SELECT file_id, seq, 3, rank FROM ct WHERE rank > 24),
un AS (SELECT *, row_number() OVER (PARTITION BY file_id, seq ORDER BY tier, rank) AS f FROM tr)
SELECT file_id, seq, tier, row_number() OVER (ORDER BY tier, rank, file_id, seq) AS slot FROM un WHERE f = 1 ORDER BY slot LIMIT 32""")
def shortlist_pool(v):
    """A budget of 32, 8 of them for the graph; a chunk takes one slot."""
    a, b = _two_lanes(v)
    content = fusion.rrf({"semantic": (a, 1.0), "fts": (b, 1.0)}).select("file_id", "seq", F.col("rrf_rank").alias("rank"))
    graph = content.where("rank <= 20").withColumn("rank", 21 - F.col("rank"))
    return fusion.build_pool(content, graph, content.limit(0)).select("file_id", "seq", F.col("tier").cast("int").alias("tier"), F.col("slot").cast("long").alias("slot"))


@query(_Q + "SELECT bl.file_id, bl.seq, round(1 / (1 + exp(-(20.777 * least(greatest(coalesce(cs.score, 0), 0), 1) + 13.377 * bm25n - 8.762))), 6) AS p FROM bl LEFT JOIN cs ON cs.seq = bl.file_id")
def calibrated_probability(v):
    """Probability from cosine and BM25, missing features as 0."""
    found = lexical.bm25(v.chunks, _words(v), COLUMNS).orderBy(F.desc("bm25"), "file_id", "seq").limit(60)
    q = F.array(*map(F.lit, map(float, _vector(v))))
    near = v.vectors.select(F.col("seq").alias("file_id"), vector.cosine(F.col("vector"), q).alias("cosine"))
    return found.join(near, "file_id", "left").select("file_id", "seq", F.round(fusion.probability(F.col("cosine"), lexical.normalized(F.col("bm25"), F.col("bound"))), 6).alias("p"))


@query(_Q + "SELECT file_id, seq, round(bm25n, 6) AS bm25n, bm25n >= 0.5 AS answer FROM bl")
def answer_floor(v):
    """Answers and the rest."""
    found = lexical.bm25(v.chunks, _words(v), COLUMNS).orderBy(F.desc("bm25"), "file_id", "seq").limit(60).withColumn("score", lexical.normalized(F.col("bm25"), F.col("bound")))
    yes, no = fusion.split_at_floor(found, 0.5)
    return yes.withColumn("answer", F.lit(True)).unionByName(no.withColumn("answer", F.lit(False))).select("file_id", "seq", F.round("score", 6).alias("bm25n"), "answer")


@query(_Q + """, c AS (SELECT file_id, seq, row_number() OVER (ORDER BY score DESC, file_id, seq) - 1 AS i FROM kn), r AS (SELECT file_id, seq, row_number() OVER (ORDER BY bm25 DESC, file_id, seq) - 1 AS i FROM bl),
k AS (SELECT file_id, seq, 4 * (i // 3) + i % 3 AS k FROM c UNION ALL SELECT file_id, seq, 4 * i + 3 FROM r) SELECT file_id, seq, row_number() OVER (ORDER BY k, file_id, seq) AS position FROM k""")
def degraded_interleave(v):
    """Three content rows, then a reserved one."""
    a, b = _two_lanes(v)
    rank = F.row_number().over(fusion.W.partitionBy(F.lit(0)).orderBy(*fusion.by_score()))
    rows = lambda x: x.select("file_id", "seq", rank.alias("rank"))
    return fusion.interleave(rows(a), rows(b)).select("file_id", "seq", F.col("position").cast("long").alias("position"))


@query(_Q + """, r AS (SELECT file_id, seq, row_number() OVER (ORDER BY bm25 DESC, file_id, seq) AS rank, ceil(length(text) * 100 / 333.0)::BIGINT AS tokens FROM bl JOIN chunks USING (file_id, seq)),
o AS (SELECT *, sum(tokens + 50) OVER (ORDER BY rank) > 2048 AND rank > 1 AS o FROM r) SELECT file_id, seq, rank::INTEGER AS rank, tokens, NOT bool_or(o) OVER (ORDER BY rank) AS admitted FROM o""")
def token_budget(v):
    """Greedy in rank order (here of the keyword lane), stopping at the first that does
    not fit."""
    lane = keyword.bm25(v.keyword, _words(v), COLUMNS).orderBy(F.desc("bm25"), "file_id", "seq").limit(60)
    rank = F.row_number().over(fusion.W.partitionBy(F.lit(0)).orderBy(F.desc("bm25"), "file_id", "seq"))
    top = lane.withColumn("rank", rank).join(v.chunks.select("file_id", "seq", "text"), ["file_id", "seq"]).select("file_id", "seq", "rank", T.packaging_tokens(F.col("text")).alias("tokens"))
    return present.pack_budget(top, 2048).select("file_id", "seq", "rank", "tokens", "admitted")


@query(r""", q AS (SELECT lower(text) AS q FROM chunks ORDER BY file_id, seq LIMIT 1), c AS (SELECT file_id, seq, lower(text) AS t FROM chunks),
s AS (SELECT file_id, seq, list_distinct([substr(t, i, 4) FOR i IN range(1, greatest(length(t) - 2, 1))]) AS a, list_distinct([substr(q, i, 4) FOR i IN range(1, greatest(length(q) - 2, 1))]) AS b FROM c, q)
SELECT file_id, seq, round(CASE WHEN len(list_distinct(a || b)) = 0 THEN 0.5 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6) AS score FROM s""")
def mock_rerank(v):
    """The deterministic reranker, four-character shingles."""
    first = v.chunks.orderBy("file_id", "seq").limit(1)
    q = F.lit(first.select(T.shingles(F.col("text")).alias("q")).first()["q"]).cast("array<string>")  # of one chunk, made once
    return v.chunks.select("file_id", "seq", F.round(T.shingle_jaccard(T.shingles(F.col("text")), q), 6).alias("score"))


@query(_Q + """, v1 AS (SELECT seq AS file_id, 0::BIGINT AS seq, vector FROM vectors),
c1 AS (SELECT file_id, v1.seq, list_dot_product(vector::DOUBLE[], q) / (sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])) * sqrt(list_dot_product(q, q))) AS score FROM v1, qv),
k1 AS (SELECT * FROM c1 ORDER BY score DESC, file_id, seq LIMIT 60),
b8 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY bm25 DESC, seq) AS r FROM bl) WHERE r <= 8),
ra AS (SELECT file_id, seq, row_number() OVER (ORDER BY score DESC, file_id, seq) AS r FROM k1 UNION ALL SELECT file_id, seq, row_number() OVER (ORDER BY bm25 DESC, file_id, seq) FROM b8),
rf AS (SELECT file_id, seq, sum(1.0 / (60 + r)) AS rrf FROM ra GROUP BY ALL), pl AS (SELECT * FROM rf ORDER BY rrf DESC, file_id, seq LIMIT 32)
SELECT pl.file_id, pl.seq, round(rrf, 8) AS rrf, round(1 / (1 + exp(-(20.777 * least(greatest(coalesce(c1.score, 0), 0), 1) + 13.377 * coalesce(CASE WHEN bound > 0 THEN bm25 / bound ELSE 0 END, 0) - 8.762))), 6) AS score
FROM pl LEFT JOIN c1 USING (file_id, seq) LEFT JOIN bm USING (file_id, seq)""")
def search_shortlist(v):
    """Both lanes fused, pooled and scored by calibrated probability
    (vectors stand for each conversation's first turn)."""
    vectors = v.vectors.select(F.col("seq").alias("file_id"), F.lit(0).cast("long").alias("seq"), "vector")
    found = shortlist(v.chunks, vectors, _words(v), _vector(v), keyword=keyword.bm25(v.keyword, _words(v), COLUMNS))
    return found.select("file_id", "seq", F.round("rrf", 8).alias("rrf"), F.round("score", 6).alias("score"))


@query()
def ranked_search_blocks(v):
    """The whole search, blocks of neighbours within the budget."""
    vectors = v.vectors.select(F.col("seq").alias("file_id"), F.lit(0).cast("long").alias("seq"), "vector")
    return S.ranked_search(v.chunks, vectors, _words(v), _vector(v)).select("file_id", "seq", "n_chunks", F.round("score", 6).alias("score"), "rank", "tokens", "admitted")


@query(_Q + """, b8 AS (SELECT file_id, seq, bm25, bound, row_number() OVER (PARTITION BY file_id ORDER BY bm25 DESC, seq) AS r FROM bl), pl AS (SELECT * FROM b8 WHERE r <= 8 ORDER BY bm25 DESC, file_id, seq LIMIT 32),
sc AS (SELECT file_id, seq, 1 / (1 + exp(-(13.377 * bm25 / bound - 8.762))) AS p, row_number() OVER (ORDER BY bm25 DESC, file_id, seq) AS k FROM pl)
SELECT sc.file_id, sc.seq, round(p, 6) AS score, ceil(length(text) * 100 / 333.0)::BIGINT AS tokens FROM sc JOIN chunks USING (file_id, seq) WHERE p >= 0.5 ORDER BY p DESC, k, file_id, seq LIMIT 10""")
def ranked_search(v):
    """The keyword-only search with a floor of 0.5, without joining blocks."""
    o = Options(top_n=10, coalesce=False, weights={"fts": 1.0}, calibration=fusion.Calibration(floor=0.5), budget_tokens=10**9)
    found = S.ranked_search(v.chunks, None, _words(v), None, o, keyword=keyword.bm25(v.keyword, _words(v), COLUMNS))
    return found.select("file_id", "seq", F.round("score", 6).alias("score"), "tokens")


@query(_Q + """, c2 AS (SELECT file_id, seq, bm25, bound, row_number() OVER (PARTITION BY file_id ORDER BY bm25 DESC, seq) AS r FROM bl), pl AS (SELECT * FROM c2 WHERE r <= 8 ORDER BY bm25 DESC, file_id, seq LIMIT 32),
sc AS (SELECT file_id, seq, 1 / (1 + exp(-(13.377 * bm25 / bound - 8.762))) AS score, row_number() OVER (ORDER BY bm25 DESC, file_id, seq) AS k FROM pl),
rk AS (SELECT sc.*, score >= 0.001 AS answer, row_number() OVER (ORDER BY score >= 0.001 DESC, score DESC, k, file_id, seq) AS rank FROM sc),
ad AS (SELECT a.*, CASE WHEN a.answer THEN 1 - (SELECT count(*) FROM rk b WHERE b.answer AND b.file_id = a.file_id AND abs(b.seq - a.seq) = 1 AND b.rank < a.rank) ELSE 0 END AS added FROM rk a),
su AS (SELECT *, sum(added) OVER (ORDER BY rank) AS blocks FROM ad),
mo AS (SELECT *, coalesce(max(blocks) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS most FROM su),
tk2 AS (SELECT * FROM mo WHERE NOT answer OR most < 8),
ig AS (SELECT *, CASE WHEN answer THEN seq - row_number() OVER (PARTITION BY file_id, answer ORDER BY seq) ELSE -1 - rank END AS island FROM tk2),
bk AS (SELECT file_id, min(ig.seq) AS seq, count(*) AS n_chunks, max(score) AS score, min(rank) AS rank, answer FROM ig GROUP BY file_id, answer, island),
sh AS (SELECT *, row_number() OVER (ORDER BY answer DESC, rank) AS place FROM bk),
pr AS (SELECT file_id, string_agg(name || '=' || value, ';' ORDER BY name, value) AS properties FROM props GROUP BY file_id)
SELECT sh.file_id, sh.seq, n_chunks::BIGINT AS n_chunks, round(score, 6) AS score, rank::BIGINT AS rank, answer, coalesce(properties, '') AS properties FROM sh LEFT JOIN pr USING (file_id) WHERE place <= 8""")
def ranked_blocks(v):
    """Eight places: answers taken until they make eight blocks (a note's
    turns are one section here), then what the floor rejected, with the notes' properties."""
    o = Options(top_n=8, weights={"fts": 1.0}, calibration=fusion.Calibration(floor=0.001), budget_tokens=10**9, less_relevant=True)
    chunks = v.chunks.withColumn("heading_path", F.lit(""))
    found = S.ranked_search(chunks, None, _words(v), None, o, keyword=keyword.bm25(v.keyword, _words(v), COLUMNS), properties=v.props)
    named = F.array_join(F.transform("properties", lambda p: F.concat(p["name"], F.lit("="), p["value"])), ";")
    return found.select("file_id", "seq", "n_chunks", F.round("score", 6).alias("score"), "rank", "answer", named.alias("properties"))
