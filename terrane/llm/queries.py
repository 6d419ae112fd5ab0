"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import bpe, decontam, html, jaccard, lines, packing, quality, search, substrings, tokens, toxicity, urls, vectors
from terrane.llm.shared import save


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), n=3, percent=90)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.passes_policy("base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.passes_policy("v1").alias("kept"), "failed")


#: (verdict, rule): what stands below a host, its subdomains and a path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Sites of advertising, adult content, gambling, pills and spam to block, where no rule decides: below their hosts, and the hosts without a path.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_HOSTS = tuple(f"{name}.example.{end}" for name in LISTED_NAMES for end in ("com", "net", "org"))
#: Pages that anyone reached with tracking parameters are listed too, by their canonical URL; not whole folders or hosts.
TRACKED = r"[?&]utm_"


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every policy and rule: documents that fail the rule, fail it alone, and pass without it. From the ledger, without the texts."""
    rows = save(quality.ledger(table(spark, sf_dir, "documents")).select("failed"))
    parts = [quality.ablations(rows, policy).withColumn("policy", F.lit(policy)) for policy in quality.POLICIES]
    return reduce(DataFrame.unionByName, parts).select("policy", "rule", "n_failed", "n_failed_alone", "n_kept_without")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = spark.range(1).select(F.explode(F.array(*(F.lit(f"http://{h}{end}") for h in LISTED_HOSTS for end in ("", "/")))).alias("url"))
    path = urls.path(F.col("url"))
    tracked = pages.select("url").where(F.rlike("url", F.lit(TRACKED)) & path.startswith("/") & ~path.endswith("/"))
    return urls.judge(pages, URL_RULES, hosts.unionByName(tracked))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_ngram_jaccard_join,
        op3_bpe_codec,
        op4_quality_rules,
        op5_url_filters,
        op6_html_extraction,
        op7_benchmark_decontamination,
        op8_token_counts,
        op9_toxicity,
        op10_substring_dedup,
        op11_vector_code_compression,
        op12_mixture_packing,
        op13_ranked_search,
        quality_ablations,
    )
}
_HOST = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in URL_RULES)
_LISTED = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
ORACLE: dict[str, str] = {
    "op4_quality_rules": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(text, chr(10)) AS l FROM t),
g AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, p + k AS pos FROM (
        SELECT doc_id, i AS p, count(*) OVER (PARTITION BY doc_id, x) AS n FROM (SELECT doc_id, unnest(g) AS x, unnest(range(1, len(g) + 1)) AS i FROM g)) CROSS JOIN (VALUES (0), (1), (2)) AS o(k) WHERE n > 1) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) AS n_lines FROM (SELECT doc_id, unnest(l) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
v AS (SELECT doc_id, count(DISTINCT x) AS n_distinct FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY doc_id),
m AS (SELECT g.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_distinct, 0) AS n_distinct, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
      FROM g LEFT JOIN c USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN v USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN n_symbols > 0.1 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END + CASE WHEN n_lines > 3 AND n_dup_lines > 0.3 * n_lines THEN 16 ELSE 0 END
        + CASE WHEN n_letters > 0 AND n_upper > 0.5 * n_letters THEN 32 ELSE 0 END + CASE WHEN n_digits > 0.3 * word_chars THEN 64 ELSE 0 END
        + CASE WHEN n_words >= 50 AND n_distinct < 0.1 * sqrt(n_words) * sqrt(50) THEN 128 ELSE 0 END)::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 255 = 0 AS kept, failed FROM f""",
    "op5_url_filters": f"""
WITH p AS (SELECT page_id, translate({_HOST}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, {_PATH} AS path FROM pages),
r AS (SELECT * FROM (VALUES {_RULES}) AS r(verdict, rule, h, b)), l AS (SELECT * FROM (VALUES {_LISTED}) AS l(h)),
t AS (SELECT DISTINCT host AS th, path AS tp FROM p JOIN pages USING (page_id) WHERE regexp_matches(url, '{TRACKED}') AND starts_with(path, '/') AND NOT ends_with(path, '/')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY page_id),
k AS (SELECT page_id, h || CASE WHEN path = '' THEN '' ELSE '/' END AS key FROM p JOIN l ON (host = h OR ends_with(host, '.' || h)) AND (path = '' OR starts_with(path, '/'))
  UNION ALL SELECT page_id, th || tp FROM p JOIN t ON path = tp AND (host = th OR ends_with(host, '.' || th))),
b AS (SELECT page_id, arg_max(key, (length(key), key)) AS listed_as FROM k GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed_as IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN rule IS NULL THEN listed_as END AS listed_as
FROM p LEFT JOIN f USING (page_id) LEFT JOIN b USING (page_id)""",
    "op7_benchmark_decontamination": """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 5) AS l FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p+l-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM b)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, l, array_to_string(w[p:p+l-1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM t CROSS JOIN (SELECT DISTINCT l FROM b) WHERE len(w) >= l))
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM s JOIN d USING (g, l) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op10_substring_dedup": """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 48, 1))) AS i, w FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM g),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM h),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT * FROM m WHERE least < doc_id) CROSS JOIN range(0, 50) AS o(k)),
r AS (SELECT doc_id, list(pos) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark),
q AS (SELECT item_id, t, count(*) AS times FROM b GROUP BY ALL),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s WHERE t IN (SELECT t FROM q) GROUP BY t, nn),
m AS (SELECT doc_id, 25 + (75 * n * nn) // l AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 10""",
}


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Product codes in SQL: every part is compared with every entry."""

    def assigned(books: str) -> str:
        return f"""SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT vec_id, x.p, e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {books} b ON x.p = b.p) GROUP BY vec_id, p"""

    steps = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)",
        f"x AS (SELECT vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM v, range({parts}) AS r(p))",
        f"o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT {entries})",
        "b0 AS (SELECT p, e, x FROM x JOIN o USING (vec_id))",
    ]
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assigned(f'b{k}')})")
        steps.append(
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS x FROM (SELECT a.p, a.e, i, floor(sum(c) / count(*))::BIGINT AS m"
            f" FROM (SELECT vec_id, p, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM x) u JOIN a{k} a ON u.vec_id = a.vec_id AND u.p = a.p GROUP BY a.p, a.e, i) GROUP BY p, e) n ON n.p = b.p AND n.e = b.e)"
        )
    steps.append(f"a AS ({assigned(f'b{rounds}')})")
    steps.append("c AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h"


ORACLE["op11_vector_code_compression"] = _codes_sql()
_POLICIES = ", ".join(f"('{policy}', {quality.mask(policy)}, '{rule}', {quality.BIT[rule]})" for policy, rules in quality.POLICIES.items() for rule in rules)
ORACLE["quality_ablations"] = f"""
WITH ledger AS ({ORACLE["op4_quality_rules"]}), r AS (SELECT * FROM (VALUES {_POLICIES}) AS r(policy, mask, rule, bit))
SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_failed_alone, count(*) FILTER (failed & mask & ~bit = 0) AS n_kept_without FROM ledger, r GROUP BY policy, rule"""
