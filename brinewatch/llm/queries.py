"""The operators over the driver's tables, as queries (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from brinewatch.llm import decision, urls
from brinewatch.llm.html import main_texts
from brinewatch.llm.kneser import perplexities
from brinewatch.llm.lm import text_scores
from brinewatch.llm.media import media_columns
from brinewatch.llm.mixing import mixed
from brinewatch.llm.near import near_groups
from brinewatch.llm.pieces import encoded
from brinewatch.llm.pii import personal_data
from brinewatch.llm.ranked import build, search
from brinewatch.llm.resample import importance
from brinewatch.llm.shuffled import sharded
from brinewatch.llm.tables import dropped, read

#: The vocabulary file; a parameter, never part of this repository.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Host and path rules, longest first where several fit.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, plain and disguised, in every text."""
    return personal_data(read(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under the hashed maximum-entropy model and the unigram base."""
    return text_scores(read(spark, sf_dir, "documents"))


def op3_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that 3-word shingles link at 85 % or more."""
    return near_groups(read(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op4_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of trusted texts, and its language's threshold."""
    return perplexities(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as sound, with digests of what is read back and of its fingerprints."""
    return media_columns(read(spark, sf_dir, "documents"), digest=True)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed rules, then mined ones, on every page's URL. A page's label is that of the document whose number ends its path."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    number = F.regexp_extract(urls.parts_of(F.col("url"))[1], r"([0-9]+)(?:/|\.html)?$", 1)
    known = labels.groupBy(F.col("doc_id").cast("string").alias("_number")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    labelled = pages.select("url", number.alias("_number")).join(known, "_number").select("url", "bad")
    return urls.judged(pages.select("page_id", "url"), URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by source so that none is dropped and none is drawn more than twice, in mixing order."""
    out = mixed(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), repetition=2.0)
    return out.select("doc_id", "source", F.col("_copy").alias("copy"), F.col("_tokens").alias("tokens"), F.col("_offset").alias("offset"), F.round("_weight", 9).alias("weight"), F.round("_position", 9).alias("position"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every text and the verdict of the base rules and of the learned list."""
    out = decision.judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    s = [F.col(f"_s.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *s, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_rule").alias("rule"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as piece ids (their number and digest), decoded again."""
    return encoded(read(spark, sf_dir, "documents"), PIECES)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    index = build(read(spark, sf_dir, "documents"))
    out = search(index, read(spark, sf_dir, "benchmark"))
    dropped(index.blocks)
    return out


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of equally many rows, in shuffled order; size and digest are those of the shuffled record."""
    out, text = sharded(read(spark, sf_dir, "documents")), F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, its score, and its rank among the quarter that is drawn."""
    return importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pii_spans, op2_lm_score, op3_minhash_near, op4_kn_quality, op5_media_features, op6_url_rules, op7_mix_sources, op8_quality_rules, op9_sentencepiece, op10_main_text,
        op11_ranked_search, op12_shards, op13_resample,
    )
}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 ln AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)), ed AS (SELECT a, b FROM ln UNION ALL SELECT b, a FROM ln),
 rc AS (SELECT DISTINCT doc_id AS x, doc_id AS y FROM w UNION SELECT x, b FROM rc JOIN ed ON y = a), cm AS (SELECT x, min(y) AS component_id FROM rc GROUP BY x)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN cm ON x = doc_id"""


def _listed(value: bool) -> str:
    def fits(rule: str) -> str:
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{URL_RULES[r] if value else r}'" for r in sorted(URL_RULES, key=lambda r: (-len(r), r))) + " END"


_OP6 = f"""WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 q AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
 tk AS (SELECT *, list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x), list_transform(list_filter(regexp_split_to_array(path, '[/._-]'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'path:' || x))) AS tokens FROM q),
 kn AS (SELECT CAST(doc_id AS VARCHAR) AS num, max(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY 1),
 lb AS (SELECT row_number() OVER () AS id, tokens, bad, substr(md5(url), 1, 1) < '5' AS held FROM tk JOIN kn ON regexp_extract(path, '([0-9]+)(?:/|\\.html)?$', 1) = num WHERE bad IS NOT NULL AND len(tokens) > 0),
 tr AS (SELECT id, bad, unnest(tokens) AS t FROM lb WHERE NOT held),
 su AS (SELECT bad, [t] AS s FROM tr UNION ALL SELECT a.bad, [a.t, b.t] FROM tr a JOIN tr b ON a.id = b.id AND a.t < b.t UNION ALL SELECT a.bad, [a.t, b.t, c.t] FROM tr a JOIN tr b ON a.id = b.id AND a.t < b.t JOIN tr c ON b.id = c.id AND b.t < c.t),
 ss AS (SELECT s FROM su GROUP BY s HAVING count(*) FILTER (bad) >= (SELECT greatest(10, ceil(0.005 * count(*))) FROM lb WHERE NOT held) AND count(*) FILTER (bad) >= 0.8 * count(*)),
 ok AS (SELECT s FROM ss JOIN lb ON list_has_all(tokens, s) GROUP BY s HAVING count(*) FILTER (bad AND held) >= 1 AND count(*) FILTER (bad AND held) >= 0.8 * count(*) FILTER (held) AND count(*) FILTER (bad) >= 0.8 * (count(*) + 1))
 SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, {_listed(False)} AS rule, coalesce({_listed(True)}, CASE WHEN EXISTS (SELECT 1 FROM ok WHERE list_has_all(tokens, s)) THEN 'block' ELSE 'allow' END) AS verdict FROM tk"""
_TERMS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OP11 = f"""WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents), dn AS (SELECT doc_id, len(ts) AS n FROM t WHERE len(ts) > 0),
 s AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM dn), m AS (SELECT doc_id, 50 + (50 * dn.n * s.N) // L AS m FROM dn, s),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM t) GROUP BY ALL), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
 w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term),
 sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc QUALIFY rank <= 50"""
#: The others' models, spans, fingerprints and permutations are beyond SQL; tests/llm holds their queries against brute force.
ORACLE = {"op3_minhash_near": _OP3, "op6_url_rules": _OP6, "op11_ranked_search": _OP11}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
