"""The registered queries of this subpackage: thin wrappers that read whole tables and return the contracts' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import ann, bytebpe, html, jaccard, language, lexical, multiset, packing, sharding, simhash, spans, urls, whitening

#: The URL rules of the contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.with_edits(read(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read(spark, sf_dir, "documents"))


def op5_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes: the labels whose id is the page's; toxic or low quality counts as bad."""
    labels = read(spark, sf_dir, "labels")
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)
    return urls.judge_urls(read(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), URL_RULES)


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op7_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_report(read(spark, sf_dir, "documents"))


def op8_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(read(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"))


def op11_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(read(spark, sf_dir, "documents"))


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_anisotropic_search, op3_multiset_hash, op4_feistel_shards, op5_host_reputation, op6_cross_parsing, op7_suffix_spans, op8_dom_model, op9_byte_bpe, op10_pack, op11_heavy_light_join, op12_jacobi_whitening, op13_threshold_search)}


def _reputation_sql() -> str:
    """op5 as one DuckDB statement: counts per host, three levels of prior strength, posterior bound, rules."""
    lower = f"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}')"
    path = r"coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '')"
    second = ", ".join(f"'{x}'" for x in urls.SECOND_LEVEL)
    tail = "array_to_string(list_slice(l, greatest(1, len(l) - {0}), len(l)), '.')"

    def strength(groups: str, n: str, k: str, p: str, out: str) -> str:
        clipped = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
        sums = f"select sum({n} * pow({k}::double / {n} - {clipped}, 2) / ({clipped} * (1 - {clipped}))) as q, count(*) as g, sum({n} - 1) as w from {groups} where {n} > 0"
        return f"{out} as (select case when coalesce(w, 0) = 0 then 10.0::double else round((1 - rho) / rho, 6) end as s from (select w, least(greatest((q - g) / nullif(w, 0)::double, 0.001), 0.5) as rho from ({sums})))"

    rule, verdict = "null::varchar", "null::varchar"
    for kind, text in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{rest}')"
        rule, verdict = f"case when {fits} then '{text}' else {rule} end", f"case when {fits} then '{kind}' else {verdict} end"
    return (
        f"with pg as (select page_id, {lower} as host, {path} as path from pages), mk as (select doc_id as page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end)::bigint as bad from labels group by doc_id), "
        "h0 as (select host, count(bad) as n_h, coalesce(sum(bad), 0)::bigint as k_h from pg left join mk using (page_id) group by host), "
        r"h1 as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') as name from h0), h2 as (select *, string_split(name, '.') as l, regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') or starts_with(name, '[') as numeric_address from h1), "
        f"h3 as (select *, len(l) >= 3 and length(l[len(l)]) = 2 and coalesce(l[len(l) - 1] in ({second}), false) as two from h2), "
        f"hosts as (select host, n_h, k_h, case when numeric_address then '' when two then {tail.format(1)} else {tail.format(0)} end as suffix, case when numeric_address then name when two then {tail.format(2)} else {tail.format(1)} end as domain from h3), "
        "tot as (select (coalesce(sum(k_h), 0) + 0.5::double) / (coalesce(sum(n_h), 0) + 10.0::double) as rate from hosts), "
        "su0 as (select suffix, sum(n_h) as n_s, sum(k_h) as k_s, any_value(rate) as p0 from hosts cross join tot group by suffix), "
        + strength("su0", "n_s", "k_s", "p0", "s1")
        + ", su as (select suffix, (k_s + s * p0) / (n_s + s) as p_s from su0 cross join s1), do0 as (select suffix, domain, sum(n_h) as n_d, sum(k_h) as k_d, any_value(p_s) as p_s from hosts join su using (suffix) group by suffix, domain), "
        + strength("do0", "n_d", "k_d", "p_s", "s2")
        + ", dm as (select domain, (k_d + s * p_s) / (n_d + s) as p_d from do0 cross join s2), hd as (select hosts.*, p_d from hosts join dm using (domain)), "
        + strength("hd", "n_h", "k_h", "p_d", "s3")
        + ", ab as (select host, k_h + s * p_d as a, n_h - k_h + s * (1 - p_d) as b from hd cross join s3), sc as (select host, a / (a + b) as bad_rate, a / (a + b) - 1.645::double * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bad_rate_low from ab) "
        f"select page_id, host, path, {rule} as rule, coalesce({verdict}, case when bad_rate_low > 0.5 then 'block' else 'allow' end) as verdict, bad_rate, bad_rate_low from pg join sc using (host)"
    )


#: op7 as DuckDB SQL: all 50-byte strings, the smallest id that has each, islands of those that go, what lies between.
SPANS_SQL = (
    "with b as materialized (select doc_id, encode(coalesce(text, '')) as d from documents), n as (select doc_id, d, octet_length(d) as n from b), "
    "s as materialized (select doc_id, p, array_slice(d, p, p + 49) as w from (select doc_id, d, unnest(range(1, n - 48)) as p from n where n >= 50)), "
    "f as (select w, min(doc_id) as first from s group by w), m as (select doc_id, p from s join f using (w) where first < doc_id), "
    "g as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh from m)), "
    "r as (select doc_id, min(p) as a, max(p) + 49 as z from g group by doc_id, run), "
    "k as (select doc_id, a as spot, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as lo, a - 1 as hi from r union all select n.doc_id, 9000000000000, coalesce(max(z), 0) + 1, any_value(n.n) from n left join r using (doc_id) group by n.doc_id), "
    "j as (select k.doc_id, string_agg(case when hi >= lo then hex(array_slice(d, lo, hi)) else '' end, '' order by spot) as kept from k join n using (doc_id) group by k.doc_id) "
    "select n.doc_id, n.n::bigint as n_bytes, coalesce(t.removed, 0)::bigint as n_removed, coalesce(t.spans, 0)::bigint as n_spans, sha256(unhex(kept)) as kept_sha256 from n join j using (doc_id) left join (select doc_id, sum(z - a + 1) as removed, count(*) as spans from r group by doc_id) t using (doc_id)"
)
#: op11 as DuckDB SQL: distinct shingles, common ones counted by pairs of distinct sets, closure over links, smallest id.
JACCARD_SQL = (
    f"with recursive w as materialized (select doc_id, list_filter(string_split_regex(translate(text, '{urls.UPPER}', '{urls.LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents), "
    "s as materialized (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end)) as s from w where w is not null), "
    "nd as materialized (select row_number() over () as node, s, len(s) as n, first from (select s, min(doc_id) as first from s where len(s) > 0 group by s)), "
    "e as materialized (select node, n, hash(t) as t from (select node, n, unnest(s) as t from nd)), "
    "c as (select x.node as a, y.node as b, any_value(x.n) + any_value(y.n) as total, count(*) as common from e x join e y on x.t = y.t and x.node <> y.node and x.n * 100 >= y.n * 85 and y.n * 100 >= x.n * 85 group by x.node, y.node), "
    "l as materialized (select a, b from c where 100 * common >= 85 * (total - common)), "
    "r as (select node, node as other from nd union select r.node, l.b from r join l on l.a = r.other), "
    "k as (select r.node, min(o.first) as component_id from r join nd o on o.node = r.other group by r.node) "
    "select d.doc_id, coalesce(nd.n, 0)::bigint as n_shingles, coalesce(k.component_id, d.doc_id) as component_id from documents d left join s using (doc_id) left join nd using (s) left join k using (node)"
)
#: op13 as DuckDB SQL: every document's score for every item.
LEXICAL_SQL = (
    r"with t as materialized (select doc_id, list_filter(string_split_regex(translate(text, '{u}', '{l}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents), "
    "d as (select doc_id, w, len(w)::bigint as n from t where len(w) > 0), st as (select count(*)::bigint as nn, sum(n)::bigint as ll from d), "
    "f as materialized (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(w) as term from d) group by all), df as (select term, count(*)::bigint as df from f group by term), "
    r"q as (select distinct item_id, unnest(list_filter(string_split_regex(translate(text, '{u}', '{l}'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark), "
    "sc as (select item_id, doc_id, sum(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score from q join f using (term) join df using (term) cross join st group by item_id, doc_id) "
    "select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from sc where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 50"
).replace("{u}", urls.UPPER).replace("{l}", urls.LOWER)
#: The other nine need hash functions, models, tokenizers or iterations that SQL does not have; tests/llm compares them with brute force.
ORACLES: dict[str, str] = {"op5_host_reputation": _reputation_sql(), "op7_suffix_spans": SPANS_SQL, "op11_heavy_light_join": JACCARD_SQL, "op13_threshold_search": LEXICAL_SQL}
