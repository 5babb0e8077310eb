"""One query for each operator family, by the identifiers of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity, text, tokens
from ..operators import blocking, decide, evaluate, features, graph, hops, models, report, sampling
from ..sources import io
from ..streaming.incremental import link_stream
from . import QUERIES, SQL
from .fixtures import CFG, PAIRS_SQL, RAW_SQL, RECORDS_SQL, block_sql, entities, linkage_records, raw_records, scored_pairs, sides, table

Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


# ---- sources and sinks

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")


@query(f"with {RAW_SQL} select entity_id, business_name, nullif(business_address, '') as business_address, country from raw")
def tsv_round_trip(spark, sf_dir):
    """Raw records written as TSV and scanned with the fixed schema."""
    path = io.scratch(spark, "tsv")
    raw_records(spark, sf_dir).select(*RECORD_COLUMNS).write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return io.read_raw(spark, path)


@query(f"with {RECORDS_SQL} select entity_id, name_normalized, address_normalized from recs where country = 'fr'")
def partition_scan(spark, sf_dir):
    """The cache written by country, one partition read with two columns."""
    path = io.scratch(spark, "cache")
    io.build_cache(linkage_records(spark, sf_dir), path)
    return io.read_partition(spark, path, "fr", ["entity_id", "name_normalized", "address_normalized"])


@query("select c_custkey, c_name, c_acctbal from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def id_lookup(spark, sf_dir):
    """Rows whose id is in a list."""
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return io.lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), wanted, "c_custkey")


@query("select doc_id, n_chars from documents where doc_id >= 100 and doc_id < 400 order by doc_id")
def range_scan(spark, sf_dir):
    """S6."""
    return table(spark, sf_dir, "documents").where(F.col("doc_id").between(100, 399)).select("doc_id", "n_chars").orderBy("doc_id")


@query("select l_orderkey::varchar as s1_id, l_partkey::varchar as pool_id from lineitem where l_linestatus = 'F' group by l_orderkey, l_partkey")
def truth_round_trip(spark, sf_dir):
    """Truth lists written as TSV, read, split."""
    path = io.scratch(spark, "truth")
    pairs = scored_pairs(spark, sf_dir)
    io.write_lists(decide.matched_lists(pairs.where("label = 1"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"))), path)
    return io.truth_pairs(io.read_truth(spark, path))


@query(f"with {RECORDS_SQL} {block_sql()}, t as (select 'name: ' || lower(trim(name_original)) || ' address: ' || lower(trim(address_original)) as text, entity_id, country from recs) select distinct sha256(t.text) as rid, t.text from ranked r join t on t.country = r.country and (t.entity_id = r.s1_id or t.entity_id = r.pool_id)")
def hand_off_records(spark, sf_dir):
    """Distinct record texts of all candidates for a model elsewhere."""
    return io.hand_off(*_linked(spark, sf_dir))[0]


def _linked(spark, sf_dir):
    """(candidates, query side, pool), all materialised."""
    s1, pool = sides(spark, sf_dir)
    return io.materialize(blocking.block(blocking.records(s1), blocking.records(pool), CFG), "candidates"), s1, pool


# ---- normalisation

NORMAL = ("name_original", "name_normalized", "name_compact", "name_sorted_tokens", "name_core")
ADDRESS = ("address_original", "address_normalized", "address_compact", "address_sorted_tokens", "postal_code", "house_number")


@query(f"with {RECORDS_SQL} select entity_id, {', '.join(NORMAL)}, array_to_string(name_tokens, '|') as name_tokens from recs")
def normalize_name(spark, sf_dir):
    """F4-F8, F10-F14."""
    return linkage_records(spark, sf_dir).select("entity_id", *NORMAL, F.array_join("name_tokens", "|").alias("name_tokens"))


@query(f"with {RECORDS_SQL} select entity_id, {', '.join(ADDRESS)}, array_to_string(address_tokens, '|') as address_tokens from recs")
def normalize_address(spark, sf_dir):
    """F9, F15-F17."""
    return linkage_records(spark, sf_dir).select("entity_id", *ADDRESS, F.array_join("address_tokens", "|").alias("address_tokens"))


@query(r"""select page_id, coalesce(nullif(regexp_extract(url, '(?:^|[^0-9])([0-9]{6})(?:[^0-9]|$)', 1), ''), nullif(regexp_extract(url, '(?:^|[^0-9])([0-9]{5})(?:-[0-9]{4})?(?:[^0-9]|$)', 1), '')) as postal_code,
regexp_replace(regexp_extract(url, '[0-9]+', 0), '^0+([0-9])', '\1') as first_number, trim(regexp_replace(regexp_replace(lower(url), '[^0-9a-z\s]+', ' ', 'g'), '\s+', ' ', 'g')) as quick from pages""")
def scalar_extracts(spark, sf_dir):
    """F15, F18, F19 on urls."""
    number = text.strip_leading_zeros(F.regexp_extract("url", "[0-9]+", 0))
    return table(spark, sf_dir, "pages").select("page_id", text.postal_code(F.col("url")).alias("postal_code"), number.alias("first_number"), text.quick_norm(F.col("url")).alias("quick"))


@query("""with t as (select doc_id, unnest(list_filter(string_split(text, ''), lambda c: not regexp_matches(c, '[\\x00-\\x7F]'))) as c, generate_subscripts(list_filter(string_split(text, ''), lambda c: not regexp_matches(c, '[\\x00-\\x7F]')), 1) as pos from documents),
n as (select doc_id, case when unicode(c) between 192 and 591 then 'latin_accent' else 'other' end as s, pos from t), k as (select doc_id, s, count(*) as n, min(pos) as pos from n group by 1, 2)
select d.doc_id, coalesce(arg_max(k.s, struct_pack(n := k.n, pos := -k.pos)), 'latin') as script from documents d left join k on d.doc_id = k.doc_id group by d.doc_id""".replace("\\\\", "\\"))
def dominant_script(spark, sf_dir):
    """F2."""
    return table(spark, sf_dir, "documents").select("doc_id", text.script(F.col("text")).alias("script"))


@query("select s_suppkey, 20000000000 + s_suppkey as number, starts_with('S2-' || s_suppkey, 'S2-') as is_s2 from supplier")
def id_numbers(spark, sf_dir):
    """D13, F23, F24."""
    tag = F.concat(F.lit("S2-"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.id_number(tag).alias("number"), tag.startswith("S2-").alias("is_s2"))


@query()
def transliteration(spark, sf_dir):
    """a fixed Devanagari sample beside each region; a state machine, not SQL."""
    sample = F.lit("राज इन्वेस्टमेंट्स प्राइवेट लिमिटेड")
    return table(spark, sf_dir, "region").select("r_regionkey", text.clean(F.concat("r_name", F.lit(" "), sample)).alias("latin"))


# ---- similarity

@query("""with n as (select n_nationkey, n_name from nation) select a.n_nationkey as a, b.n_nationkey as b, round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 6) as jw from n a join n b on a.n_nationkey < b.n_nationkey""")
def jaro_winkler(spark, sf_dir):
    """M2 on nation names."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("n"))
    pairs = n.alias("a").join(n.alias("b"), F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), F.round(similarity.scores(F.col("a.n"), F.col("b.n"), ("jw",))["jw"], 6).alias("jw"))


@query()
def similarity_scores(spark, sf_dir):
    """M1-M6: all scorers on candidates' names; tests hold them against dynamic programming."""
    s1, pool = sides(spark, sf_dir)
    pairs = features.with_sides(blocking.block(blocking.records(s1), blocking.records(pool), CFG), s1, pool, ("name_normalized",))
    return pairs.select("country", "s1_id", "pool_id", similarity.scores(F.col("name_normalized_1"), F.col("name_normalized_2")).alias("s")).select("country", "s1_id", "pool_id", "s.*")


@query("""with t as (select p_partkey, p_name, lead(p_name) over (order by p_partkey) as other from part), s as (select *, list_distinct(list_filter(string_split(p_name, ' '), lambda w: w <> '')) as x, list_distinct(list_filter(string_split(other, ' '), lambda w: w <> '')) as y from t where other is not null)
select p_partkey, round(case when len(x) = 0 and len(y) = 0 then 1.0 when len(x) = 0 or len(y) = 0 then 0.0 else len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) end, 6)::double as jaccard from s""")
def token_jaccard(spark, sf_dir):
    """M11 of neighbouring parts' names."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return rows.select("p_partkey", F.round(tokens.jaccard(F.col("p_name"), F.col("other")), 6).alias("jaccard"))


# ---- token statistics

@query(f"with {RECORDS_SQL} {block_sql()} select country, token, df, round(idf, 6) as idf from name_df")
def token_idf(spark, sf_dir):
    """T1-T5."""
    return tokens.document_frequency(linkage_records(spark, sf_dir).where("source <> 'S1'"), "name_tokens").select("country", "token", "df", *r6("idf"))


SETS_SQL = """, p as (select r.country, r.s1_id, r.pool_id, list_distinct(a.nt) as x, list_distinct(b.nt) as y from ranked r join canon a on a.country = r.country and a.id = r.s1_id join canon b on b.country = r.country and b.id = r.pool_id),
s as (select *, len(x) as n1, len(y) as n2, len(list_intersect(x, y)) as i, list_filter(x, lambda t: regexp_matches(t, '[0-9]')) as dx, list_filter(y, lambda t: regexp_matches(t, '[0-9]')) as dy, len(x) > 0 and len(y) > 0 as ok from p)"""


@query(f"""with {RECORDS_SQL} {block_sql()} {SETS_SQL} select country, s1_id, pool_id, n1::int as n1, n2::int as n2, case when ok then i::int end as inter, round(case when ok then i / (n1 + n2 - i)::double end, 6) as jaccard, round(case when ok then 2.0 * i / (n1 + n2)::double end, 6) as dice,
round(case when ok then i / n1::double end, 6) as cont1, round(case when ok then i / n2::double end, 6) as cont2, round(case when ok and len(dx) > 0 and len(dy) > 0 then len(list_intersect(dx, dy)) / len(list_distinct(list_concat(dx, dy)))::double end, 6) as num_jaccard from s""")
def overlap_features(spark, sf_dir):
    """T10, T13 of the candidates' names."""
    s1, pool = sides(spark, sf_dir)
    pairs = features.with_sides(blocking.block(blocking.records(s1), blocking.records(pool), CFG), s1, pool, ("name_tokens",))
    return pairs.select("country", "s1_id", "pool_id", *[F.round(v, 6).alias(k) if k not in ("n1", "n2", "inter") else v.alias(k) for k, v in tokens.shares(F.col("name_tokens_1"), F.col("name_tokens_2")).items()])


@query(f"""with {RECORDS_SQL} {block_sql()}, uw as (select c.country, c.id, c.token, coalesce(d.idf, ln(m.n + 1.0::double)) as w from (select country, id, unnest(list_distinct(nt)) as token from canon) c left join name_df d using (country, token) join n_pool m using (country)),
tot as (select country, id, sum(w) as s, sum(w * w) as q from uw group by 1, 2), sh as (select r.country, r.s1_id, r.pool_id, sum(a.w) as s, sum(a.w * a.w) as q from ranked r join uw a on a.country = r.country and a.id = r.s1_id join uw b on b.country = r.country and b.id = r.pool_id and a.token = b.token group by 1, 2, 3)
select r.country, r.s1_id, r.pool_id, round(case when a.s is not null and b.s is not null then coalesce(sh.q, 0) / sqrt(a.q * b.q) end, 6) as nt_idf_cos, round(case when a.s is not null and b.s is not null then coalesce(sh.s, 0) / a.s end, 6) as nt_idf_ov1, round(case when a.s is not null and b.s is not null then coalesce(sh.s, 0) / b.s end, 6) as nt_idf_ov2
from ranked r left join sh using (country, s1_id, pool_id) left join tot a on a.country = r.country and a.id = r.s1_id left join tot b on b.country = r.country and b.id = r.pool_id""")
def idf_overlap(spark, sf_dir):
    """T11, T12 of the candidates' names."""
    found, s1, pool = _linked(spark, sf_dir)
    pairs = found.select("country", "s1_id", "pool_id")
    left, right = s1.withColumnRenamed("entity_id", "s1_id"), pool.withColumnRenamed("entity_id", "pool_id")
    rows = tokens.weighted_overlap(pairs, left, right, tokens.document_frequency(pool, "name_tokens"), "name_tokens", ("s1_id", "pool_id"), "nt")
    return rows.select("country", "s1_id", "pool_id", *r6("nt_idf_cos", "nt_idf_ov1", "nt_idf_ov2"))


@query("select p_partkey, count(*) over (partition by p_brand, p_name) as name_freq, round(ln(1 + count(*) over (partition by p_brand, p_name)), 6) as log_freq from part")
def value_frequency(spark, sf_dir):
    """T14."""
    part = table(spark, sf_dir, "part")
    n = tokens.value_frequency(part, "p_name", "p_brand")
    return part.select("p_partkey", n.alias("name_freq"), F.round(F.log1p(n), 6).alias("log_freq"))


# ---- joins and retrieval

def _keys(spark, sf_dir):
    """Both sides with the columns of retrieval alone, normalised once."""
    needed = ("entity_id", "country", "source", "name_tokens", "address_tokens", "name_normalized", "name_compact", "name_core", "postal_code")
    found = io.materialize(linkage_records(spark, sf_dir).select(*needed), "keys")
    return blocking.records(found.where("source = 'S1'")), blocking.records(found.where("source <> 'S1'"))


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, n, round(w, 6) as w from addr_hits")
def rare_token_join(spark, sf_dir):
    """J1, J6, J18, W1, W2."""
    return blocking.rare_token_join(*_keys(spark, sf_dir), "address_tokens", CFG.k_address, CFG.df_cap).select("country", "s1_id", "pool_id", "n", *r6("w"))


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, n from name_hits_ order by all".replace("name_hits_", "comp_hits"))
def exact_key_join(spark, sf_dir):
    """J2."""
    s1, pool = _keys(spark, sf_dir)
    return blocking.key_join(blocking.exact_keys(s1, "name_compact"), blocking.exact_keys(pool, "name_compact"), CFG.exact_cap)


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, n from ab_hits")
def bigram_join(spark, sf_dir):
    """J3."""
    s1, pool = _keys(spark, sf_dir)
    return blocking.key_join(blocking.bigram_keys(s1, "address_tokens"), blocking.bigram_keys(pool, "address_tokens"), CFG.address_bigram_cap)


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, n from px_hits")
def prefix_join(spark, sf_dir):
    """J4."""
    s1, pool = _keys(spark, sf_dir)
    return blocking.key_join(blocking.prefix_keys(s1, 8), blocking.prefix_keys(pool, 8), CFG.prefix_cap)


COUNTS = ("n_name_shared", "n_addr_shared", "exact_name", "exact_compact", "postal_eq", "n_addr_bigram", "n_name_bigram", "n_prefix", "n_strategies")


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, {', '.join(COUNTS)}, {q6('idf_name', 'idf_addr', 'block_score')} from evidence")
def link_evidence(spark, sf_dir):
    """J5, A1, A2, U2."""
    return blocking.evidence(*_keys(spark, sf_dir), CFG).select("country", "s1_id", "pool_id", *COUNTS, *r6("idf_name", "idf_addr", "block_score"))


@query(f"with {RECORDS_SQL} {block_sql()} select country, s1_id, pool_id, place::int as place, n_strategies, {q6('ov_name', 'ov_addr', 'rank_score')} from ranked")
def link_documents_topk(spark, sf_dir):
    """The flagship, candidates of every S1 document, best first."""
    return blocking.block(*_keys(spark, sf_dir), CFG).select("country", "s1_id", "pool_id", "place", "n_strategies", *r6("ov_name", "ov_addr", "rank_score"))


@query("""with s as (select c_custkey::varchar as id, c_nationkey as country, list_transform(string_split(lower(c_name), '#'), lambda t: regexp_replace(t, '^0+([0-9])', '\\1')) as w from customer), p as (select s_suppkey::varchar as id, s_nationkey as country, list_transform(string_split(lower(s_name), '#'), lambda t: regexp_replace(t, '^0+([0-9])', '\\1')) as w from supplier)
select s.country, s.id as s1_id, p.id as pool_id from s join p on s.country = p.country and s.w[2] = p.w[2]""".replace("\\\\", "\\"))
def numeric_key_link(spark, sf_dir):
    """F18, J2 on zero-padded numbers of customers and suppliers of a nation."""
    def side(name: str, p: str) -> DataFrame:
        words = tokens.canonical(F.split(F.lower(f"{p}_name"), "#"))
        return table(spark, sf_dir, name).select(F.col(f"{p}_nationkey").alias("country"), F.col("c_custkey" if p == "c" else "s_suppkey").cast("string").alias("id"), F.get(words, F.lit(1)).alias("key")).where("key is not null")

    return blocking.key_join(side("customer", "c"), side("supplier", "s"), 10_000).drop("n")


@query(f"with {PAIRS_SQL} select p.s1_id, p.pool_id, coalesce(t.label, 0) as label from pairs p left join (select distinct l_orderkey as s1_id, l_partkey as pool_id, 1 as label from lineitem where l_linestatus = 'F') t using (s1_id, pool_id)")
def label_join(spark, sf_dir):
    """J7."""
    truth = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("pool_id"))
    return evaluate.label_pairs(scored_pairs(spark, sf_dir).select("s1_id", "pool_id"), truth)


@query(f"with {PAIRS_SQL} select p.s1_id, p.pool_id, o.s1_id as owner from pairs p left join (select pool_id, min(s1_id) as s1_id from pairs where label = 1 group by 1) o using (pool_id) where p.label = 0 and p.p >= 0.9")
def owner_lookup(spark, sf_dir):
    """Who truly owns the records of confident false pairs."""
    pairs = scored_pairs(spark, sf_dir)
    owners = pairs.where("label = 1").groupBy("pool_id").agg(F.min("s1_id").alias("owner"))
    return pairs.where("label = 0 and p >= 0.9").join(owners, "pool_id", "left").select("s1_id", "pool_id", "owner")


@query("""with v as (select vec_id, label, embedding from embeddings), s as (select q.vec_id as q_id, p.vec_id as p_id, list_cosine_similarity(q.embedding::double[], p.embedding::double[]) as c from v q join v p on q.label = p.label and q.vec_id <> p.vec_id where q.vec_id % 10 = 0)
select q_id, p_id, round(c, 6) as dense_score, k::int as dense_rank from (select *, row_number() over (partition by q_id order by round(c, 12) desc, p_id) as k from s) where k <= 10""")
def dense_knn(spark, sf_dir):
    """Exact neighbours of a stated query set within the label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))
    return hops.dense_search(vectors.where("id % 10 = 0"), vectors, k=10).select("q_id", "p_id", *r6("dense_score"), "dense_rank")


@query(f"with {PAIRS_SQL}, t as (select s1_id, pool_id from pairs where label = 1), w as (select s1_id, arg_min(pool_id, md5('7:' || s1_id || ':' || pool_id)) as negative_id from pairs where label = 0 group by 1) select t.s1_id, t.pool_id, coalesce(w.negative_id, -1) as negative_id from t left join w using (s1_id)")
def hard_negative_triples(spark, sf_dir):
    """J20, U4."""
    pairs = scored_pairs(spark, sf_dir)
    return sampling.hard_triples(pairs, pairs.where("label = 1"), seed=7)


# ---- scored graph

CONTEXT = ("top1", "top2", "top3", "sum", "best_other", "gap_to_best_other")
COUNTED = ("rank", "count", *[f"n_ge_{c}" for c in graph.CUTS])


def _context_sql(keys: str, prefix: str) -> str:
    ge = ", ".join(f"sum((p >= {c / 100}::double)::int) over g as {prefix}n_ge_{c}" for c in graph.CUTS)
    return f"""with {PAIRS_SQL}, r as (select *, row_number() over (partition by {keys} order by p desc, pool_id) - 1 as k from pairs), c as (select s1_id, pool_id, p, k as {prefix}rank,
coalesce(max(case when k = 0 then p end) over g, 0) as {prefix}top1, coalesce(max(case when k = 1 then p end) over g, 0) as {prefix}top2, coalesce(max(case when k = 2 then p end) over g, 0) as {prefix}top3, sum(p) over g as {prefix}sum, count(*) over g as {prefix}count, {ge} from r window g as (partition by {keys})),
d as (select *, case when {prefix}rank = 0 then {prefix}top2 else {prefix}top1 end as {prefix}best_other from c), e as (select *, p - {prefix}best_other as {prefix}gap_to_best_other from d)
select s1_id, pool_id, {", ".join(f"{prefix}{c}::bigint as {prefix}{c}" for c in COUNTED)}, {q6(*[prefix + c for c in CONTEXT])} from e"""


def _context(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("s1_id", "pool_id", *[F.col(f"{prefix}{c}").cast("long").alias(f"{prefix}{c}") for c in COUNTED], *r6(*[prefix + c for c in CONTEXT]))


@query(_context_sql("s1_id", "e_"))
def entity_context(spark, sf_dir):
    """W8, A26."""
    return _context(graph.entity_context(scored_pairs(spark, sf_dir), ("s1_id",), "e_"), "e_")


@query(_context_sql("s1_id, is_s2", "s_"))
def source_context(spark, sf_dir):
    """W9."""
    return _context(graph.entity_context(scored_pairs(spark, sf_dir), ("s1_id", "is_s2"), "s_"), "s_")


POOL = ("ps_best_other", "ps_gap_best_other", "ps_sum_other", "ps_q")
POOL_COUNTS = ("ps_n_claim", "ps_rank", "ps_n_other_ge50")


@query(f"""with {PAIRS_SQL}, x as (select s1_id, pool_id, least(greatest(p, 0.000001::double), 0.999999::double) as p from pairs), r as (select *, row_number() over (partition by pool_id order by p desc, s1_id) - 1 as k from x),
c as (select *, coalesce(max(case when k = 0 then p end) over g, 0) as t1, coalesce(max(case when k = 1 then p end) over g, 0) as t2, count(*) over g as n, sum(p) over g as s, sum(p / (1 - p)) over g as o, sum((p >= 0.5)::int) over g as h from r window g as (partition by pool_id)),
d as (select *, case when k = 0 then t2 else t1 end as b from c) select s1_id, pool_id, n::bigint as ps_n_claim, k::bigint as ps_rank, (h - (p >= 0.5)::int)::bigint as ps_n_other_ge50, round(b, 6) as ps_best_other, round(p - b, 6) as ps_gap_best_other, round(s - p, 6) as ps_sum_other, round(p / (1 - p) / (1 + o), 6) as ps_q from d""")
def pool_competition(spark, sf_dir):
    """W10, D11."""
    return graph.pool_competition(scored_pairs(spark, sf_dir)).select("s1_id", "pool_id", *[F.col(c).cast("long").alias(c) for c in POOL_COUNTS], *r6(*POOL))


@query(f"""with {PAIRS_SQL}, x as (select s1_id, pool_id, least(greatest(p, 0.000001::double), 0.999999::double) as p, (s1_id % 5 = 0)::int as is_new from pairs), f as (select * from x where is_new = 0),
fk as (select *, row_number() over (partition by pool_id order by p desc) as k from f), a as (select pool_id, count(*) as n, sum(p) as s, sum(p / (1 - p)) as o, sum((p >= 0.5)::int) as g, max(p) as t1, max(case when k = 2 then p end) as t2 from fk group by 1),
z as (select x.*, coalesce(n, 0) as n, coalesce(s, 0) as s, coalesce(o, 0) as o, coalesce(g, 0) as g, coalesce(t1, 0) as t1, coalesce(t2, 0) as t2, (select count(*) from f where f.pool_id = x.pool_id and f.p > x.p) as k from x left join a using (pool_id)),
b as (select *, case when is_new = 1 then t1 when p >= t1 - 1e-12::double then t2 else t1 end as best from z)
select s1_id, pool_id, (n + is_new)::bigint as ps_n_claim, k::bigint as ps_rank, greatest(case when is_new = 1 then g else g - (p >= 0.5)::int end, 0)::bigint as ps_n_other_ge50, round(best, 6) as ps_best_other, round(p - best, 6) as ps_gap_best_other,
round(greatest(case when is_new = 1 then s else s - p end, 0), 6) as ps_sum_other, round(case when is_new = 1 then p / (1 - p) / (1 + o + p / (1 - p)) else p / (1 - p) / (1 + o) end, 6) as ps_q from b""")
def pool_competition_new(spark, sf_dir):
    """Orders divisible by 5 stand for new pairs."""
    pairs = scored_pairs(spark, sf_dir).withColumn("is_new", (F.col("s1_id") % 5 == 0).cast("int"))
    rows = graph.pool_competition_new(pairs.where("is_new = 0"), pairs)
    return rows.select("s1_id", "pool_id", *[F.col(c).cast("long").alias(c) for c in POOL_COUNTS], *r6(*POOL))


@query(f"""with {PAIRS_SQL}, j as (select *, (label * 0.4 + p * 0.6)::double as name_ratio, case when pool_id % 3 > 0 then p end as addr_ratio from pairs), z as (select *, coalesce(name_ratio, 0) as nr, coalesce(addr_ratio, 0) as ar from j)
select s1_id, pool_id, round(0.5::double * nr + 0.5::double * ar, 6) as prelim_score, (row_number() over (partition by s1_id order by round(0.5::double * nr + 0.5::double * ar, 9) desc, pool_id))::int as prelim_rank, round(max(addr_ratio) over e - addr_ratio, 6) as addr_ratio_gap, round(least(nr, ar), 6) as sim_min, round(nr * ar, 6) as sim_prod,
count(*) over e as n_candidates_for_entity, (sum((nr >= 0.9)::int) over e)::bigint as n_name_ge90, (sum((nr >= 0.85 and ar >= 0.7)::int) over e)::bigint as n_both_strong, (nr >= max(nr) over e)::int as is_name_top1 from z window e as (partition by s1_id)""")
def relative_features(spark, sf_dir):
    """P11, W4-W7, K1 on scores made from labels and quantities."""
    rows = scored_pairs(spark, sf_dir).withColumns({"country": F.lit("all"), "name_ratio": F.col("label") * 0.4 + F.col("p") * 0.6, "addr_ratio": F.when(F.col("pool_id") % 3 > 0, F.col("p")), "rank_score": F.col("p")})
    rows = features.relative(rows).withColumn("prelim_rank", features.rank_desc(F.round("prelim_score", 9)))
    return rows.select("s1_id", "pool_id", "prelim_rank", "n_candidates_for_entity", "n_name_ge90", "n_both_strong", "is_name_top1", *r6("prelim_score", "addr_ratio_gap", "sim_min", "sim_prod"))


@query(f"with {RECORDS_SQL} {block_sql()} select r.country, r.s1_id, r.pool_id, (length(a.name_normalized) = 0)::int as name_missing_1, (length(b.address_normalized) = 0)::int as addr_missing_2, (a.name_normalized <> '' and a.name_normalized = b.name_normalized)::int as name_exact_normalized, (a.name_core <> '' and a.name_core = b.name_core)::int as name_exact_core, (a.address_normalized <> '' and a.address_normalized = b.address_normalized)::int as addr_exact_normalized, (a.postal_code is not null and b.postal_code is not null)::int as postal_both_present, coalesce(a.house_number = b.house_number, false)::int as housenum_match from ranked r join recs a on a.entity_id = r.s1_id join recs b on b.entity_id = r.pool_id")
def pair_flags(spark, sf_dir):
    """P10."""
    s1, pool = sides(spark, sf_dir)
    rows = features.with_sides(blocking.block(blocking.records(s1), blocking.records(pool), CFG), s1, pool).withColumns(features.flags())
    return rows.select("country", "s1_id", "pool_id", "name_missing_1", "addr_missing_2", "name_exact_normalized", "name_exact_core", "addr_exact_normalized", "postal_both_present", "housenum_match")


@query()
def matcher_features(spark, sf_dir):
    """All features of the candidates; similarities have no SQL."""
    return features.pair_features(*_linked(spark, sf_dir))


@query()
def filter_features(spark, sf_dir):
    """C5, M7."""
    return features.filter_features(*_linked(spark, sf_dir))


@query()
def graph_features(spark, sf_dir):
    """Siblings and address structure of the candidates."""
    found, s1, pool = _linked(spark, sf_dir)
    pairs = found.withColumn("p", F.least(F.col("rank_score") / 2.5, F.lit(1.0)))
    parsed = [df.select("country", F.col("entity_id").alias(k), *extra, graph.parsed_address("address_original").alias(a)) for df, k, a, extra in ((s1, "s1_id", "a1", []), (pool, "pool_id", "a2", [F.col("name_normalized").alias("name"), F.col("address_normalized").alias("addr")]))]
    rows = pairs.join(parsed[0], ["country", "s1_id"]).join(parsed[1], ["country", "pool_id"])
    rows = graph.address_structure(graph.siblings(rows, ("country", "s1_id")), "a1", "a2")
    return graph.pool_competition(graph.entity_context(rows, ("country", "s1_id"), "e_"), ("country", "pool_id")).drop("a1", "a2")


# ---- decisions and evaluation

@query(f"with {PAIRS_SQL} select s1_id, pool_id, p >= 0.5 as keep_global, case when is_s2 then p >= 0.3 else p >= 0.7 end as keep_source, case when is_s2 then p >= 0.3 else p >= 0.7 end and max(p) over (partition by s1_id) >= 0.9 as keep_gated from pairs")
def decision_modes(spark, sf_dir):
    """P1-P3, W12."""
    rows = decide.decide(scored_pairs(spark, sf_dir)).withColumnRenamed("keep", "keep_global")
    rows = decide.decide(rows, "per_source", s2=0.3, s3=0.7).withColumnRenamed("keep", "keep_source")
    return decide.decide(rows, "gated", s2=0.3, s3=0.7, gate=0.9).withColumnRenamed("keep", "keep_gated").select("s1_id", "pool_id", "keep_global", "keep_source", "keep_gated")


@query()
def decide_expected(spark, sf_dir):
    """A Poisson-binomial optimum, not SQL; tests hold it against enumeration."""
    return decide.decide_expected(scored_pairs(spark, sf_dir)).select("s1_id", "pool_id", "keep")


@query(f"with {PAIRS_SQL} select o_orderkey as s1_id, coalesce(string_agg(pool_id::varchar, ',' order by pool_id), '') as matched_ids from orders left join (select * from pairs where p >= 0.8) k on o_orderkey = s1_id group by 1")
def output_lists(spark, sf_dir):
    """A9, D14, J14, S11."""
    return decide.matched_lists(scored_pairs(spark, sf_dir).where("p >= 0.8"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")))


@query(f"with {PAIRS_SQL} select s1_id, pool_id, 'not a candidate' as problem from pairs where p < 0.1 and p >= 0.05")
def invariant_check(spark, sf_dir):
    """Matches against a candidate set that lacks some of them."""
    pairs = scored_pairs(spark, sf_dir)
    return decide.broken_invariants(pairs.where("p >= 0.05"), pairs.where("p >= 0.1"), entities(spark, sf_dir))


STATS_SQL = f"""{PAIRS_SQL}, c as (select r.s1_id, r.truth_size, coalesce(sum(case when p >= 0.5 and label = 1 then 1 end), 0) as tp, coalesce(sum(case when p >= 0.5 and label = 0 then 1 end), 0) as fp from required r left join pairs p using (s1_id) group by 1, 2),
stats as (select s1_id, tp::bigint as tp, fp::bigint as fp, (truth_size - tp)::bigint as fn, truth_size, (tp + fp)::bigint as pred_size, case when tp + fp > 0 then tp / (tp + fp)::double when truth_size > 0 then 0.0::double end as precision, case when truth_size > 0 then tp / truth_size::double end as recall,
case when truth_size = 0 then (tp + fp = 0)::int::double else 1.25 * tp / (1.25 * tp + 0.25 * (truth_size - tp) + fp)::double end as f05 from c)"""


def _stats(spark, sf_dir):
    pairs = scored_pairs(spark, sf_dir)
    return evaluate.score_pairs(pairs.where("p >= 0.5"), pairs.where("label = 1"), entities(spark, sf_dir))


@query(f"with {STATS_SQL} select s1_id, tp, fp, fn, truth_size, pred_size, {q6('precision', 'recall', 'f05')} from stats")
def entity_scores(spark, sf_dir):
    """J8, A10, A11."""
    return _stats(spark, sf_dir).select("s1_id", "tp", "fp", "fn", "truth_size", "pred_size", *r6("precision", "recall", "f05"))


SUMMARY = ("macro_f05", "singleton_accuracy", "false_merge_rate_on_singletons", "mean_precision_non_singleton", "mean_recall_non_singleton", "mean_f05_non_singleton", "mean_pred_size", "mean_truth_size")


@query(f"""with {STATS_SQL}, s as (select count(*) as n_entities, avg(f05) as macro_f05, count(*) filter (truth_size = 0) as n_singletons_true, avg((pred_size = 0)::int) filter (truth_size = 0) as singleton_accuracy, avg((pred_size > 0)::int) filter (truth_size = 0) as false_merge_rate_on_singletons, avg(precision) filter (truth_size > 0) as mean_precision_non_singleton,
avg(recall) filter (truth_size > 0) as mean_recall_non_singleton, avg(f05) filter (truth_size > 0) as mean_f05_non_singleton, avg(pred_size) as mean_pred_size, avg(truth_size) as mean_truth_size, sum(tp)::bigint as total_tp, sum(fp)::bigint as total_fp, sum(fn)::bigint as total_fn from stats) select n_entities, n_singletons_true, total_tp, total_fp, total_fn, {q6(*SUMMARY)} from s""")
def evaluation_summary(spark, sf_dir):
    """A12."""
    return evaluate.summarize(_stats(spark, sf_dir)).select("n_entities", "n_singletons_true", "total_tp", "total_fp", "total_fn", *r6(*SUMMARY))


@query(f"""with {PAIRS_SQL}, g as (select unnest(range(5, 100)) as cell), x as (select s1_id, label, floor(p * 100 + 1e-9::double)::int as c from pairs), k as (select r.s1_id, r.truth_size, g.cell, coalesce(sum(x.label), 0) as tp, count(x.label) as n from required r cross join g left join x on x.s1_id = r.s1_id and x.c >= g.cell group by 1, 2, 3)
select cell / 100.0::double as threshold, round(avg(case when truth_size = 0 then (n = 0)::int::double else 1.25 * tp / (1.25 * tp + 0.25 * (truth_size - tp) + n - tp)::double end), 6) as macro_f05 from k group by 1""")
def threshold_sweep(spark, sf_dir):
    """A13."""
    return evaluate.threshold_sweep(scored_pairs(spark, sf_dir), entities(spark, sf_dir)).select("threshold", *r6("macro_f05"))


@query()
def threshold_ascent(spark, sf_dir):
    """Coordinate ascent from the sweep's best, then the gated rule; a driver loop over small aggregates."""
    pairs, required = scored_pairs(spark, sf_dir), entities(spark, sf_dir)
    start, _ = evaluate.best_threshold(evaluate.threshold_sweep(pairs, required))
    plain = evaluate.coordinate_ascent(pairs, required, start)
    gated = evaluate.coordinate_ascent(pairs, required, {"s2": plain["s2"], "s3": plain["s3"]}, gated=True)
    rows = [("per_source", plain), ("gated", gated)]
    return spark.createDataFrame([(m, c["gate"], c["s2"], c["s3"], c["macro_f05"], m == "per_source" or c["macro_f05"] >= plain["macro_f05"] + 1e-3) for m, c in rows], "mode string, gate double, s2 double, s3 double, macro_f05 double, adopted boolean")


FLOORS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9)


@query(f"""with {PAIRS_SQL}, f as (select unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9]::double[]) as floor), t as (select count(*) as e, sum(truth_size) as n from required), k as (select f.floor, count(*) as kept, sum(label) as hit, count(distinct s1_id) as cov from pairs join f on p >= f.floor group by 1)
select floor, round(kept / e::double, 6) as candidates_per_entity, round(hit / n::double, 6) as recall_all_true_pairs, round(1 - cov / e::double, 6) as entities_without_candidates from k cross join t""")
def floor_tradeoff(spark, sf_dir):
    """A16, P5, P6."""
    rows = evaluate.tradeoff(scored_pairs(spark, sf_dir), entities(spark, sf_dir), FLOORS)
    return rows.select("floor", *r6("candidates_per_entity", "recall_all_true_pairs", "entities_without_candidates"))


@query(f"with {PAIRS_SQL}, k as (select label, row_number() over (partition by s1_id order by p desc, pool_id) as k from pairs), n as (select sum(truth_size) as n from required) select round((select sum(label) from k where k <= 1) / n::double, 6) as recall_at_1, round((select sum(label) from k where k <= 3) / n::double, 6) as recall_at_3, round((select sum(label) from k where k <= 5) / n::double, 6) as recall_at_5 from n")
def recall_at_k(spark, sf_dir):
    """A17, W15."""
    return evaluate.recall_at(scored_pairs(spark, sf_dir), entities(spark, sf_dir), (1, 3, 5)).select(*r6("recall_at_1", "recall_at_3", "recall_at_5"))


@query(f"with {PAIRS_SQL}, r as (select label, avg(k) over (partition by p) as mid from (select label, p, row_number() over (order by p) as k from pairs)) select round((sum(mid * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))::double, 6)::double as auc from r")
def auc(spark, sf_dir):
    """A23."""
    return evaluate.auc(scored_pairs(spark, sf_dir)).select(*r6("auc"))


@query(f"with {RECORDS_SQL} {block_sql()}, q as (select country, count(*) as n_query from s1 group by 1), c as (select country, count(*) as n_pairs from ranked group by 1) select q.country, n_query, n as n_pool, coalesce(n_pairs, 0) as n_pairs, round(1 - coalesce(n_pairs, 0) / (n_query::double * n), 6) as reduction_ratio from q join n_pool using (country) left join c using (country)")
def reduction_ratio(spark, sf_dir):
    """A25."""
    s1, pool = _keys(spark, sf_dir)
    return evaluate.reduction_ratio(blocking.block(s1, pool, CFG), s1, pool).select("country", "n_query", "n_pool", "n_pairs", *r6("reduction_ratio"))


def _labelled(spark, sf_dir):
    """Candidates with synthetic truth: equal addresses after normalisation."""
    s1, pool = sides(spark, sf_dir)
    rows = features.with_sides(blocking.block(blocking.records(s1), blocking.records(pool), CFG), s1, pool, ("address_normalized", "name_core", "name_script"))
    return rows.withColumn("label", (F.col("address_normalized_1") == F.col("address_normalized_2")).cast("int"))


LABELLED_SQL = f"{RECORDS_SQL} {block_sql()}, lab as (select r.*, (a.address_normalized = b.address_normalized)::int as label from ranked r join recs a on a.entity_id = r.s1_id join recs b on b.entity_id = r.pool_id)"
RULES = ("n_name_shared", "n_addr_shared", "exact_name", "exact_compact", "postal_eq", "n_addr_bigram", "n_name_bigram", "n_prefix")


@query(f"with {LABELLED_SQL}, x as (select *, {' + '.join(f'({r} > 0)::int' for r in RULES)} as total from lab) " + " union all ".join(f"select '{r}' as rule, round(avg(({r} > 0)::int), 6) as share, round(avg(({r} > 0)::int) filter (label = 1), 6) as share_of_true, count(*) filter ({r} > 0 and total = 1) as only_this from x" for r in RULES))
def rule_contribution(spark, sf_dir):
    """A18."""
    return report.rule_contribution(_labelled(spark, sf_dir), RULES).select("rule", "only_this", *r6("share", "share_of_true"))


@query(f"""with {LABELLED_SQL}, t as (select a.country, a.entity_id as s1_id, b.entity_id as pool_id, a.name_core as c1, b.name_core as c2, b.address_normalized as a2, a.address_normalized as a1 from recs a join recs b on a.country = b.country and a.address_normalized = b.address_normalized and a.source = 'S1' and b.source <> 'S1'),
m as (select t.*, len(list_intersect(list_filter(string_split(c1, ' '), lambda w: w <> ''), list_filter(string_split(c2, ' '), lambda w: w <> ''))) as n, len(list_intersect(list_filter(string_split(a1, ' '), lambda w: w <> ''), list_filter(string_split(a2, ' '), lambda w: w <> ''))) as k from t left join ranked r using (country, s1_id, pool_id) where r.s1_id is null)
select case when trim(a2) = '' then 'no address' when n = 0 and k = 0 then 'no shared token' when n = 0 then 'no shared name token' when k = 0 then 'no shared address token' else 'shared tokens, dropped' end as category, count(*) as n from m group by 1""")
def missed_pairs(spark, sf_dir):
    """Synthetic true pairs (equal normalised addresses) that were not retrieved."""
    s1, pool = sides(spark, sf_dir)
    a = s1.select("country", F.col("entity_id").alias("s1_id"), F.col("address_normalized").alias("addr_1"), F.col("name_core").alias("core_1"))
    b = pool.select("country", F.col("entity_id").alias("pool_id"), F.col("address_normalized").alias("addr_2"), F.col("name_core").alias("core_2"))
    true = a.join(b, (a["country"] == b["country"]) & (F.col("addr_1") == F.col("addr_2"))).drop(b["country"])
    found = blocking.block(blocking.records(s1), blocking.records(pool), CFG).select("country", "s1_id", "pool_id")
    return report.missed_categories(true.join(found, ["country", "s1_id", "pool_id"], "left_anti").withColumn("script_2", F.lit("latin")))


EDGES = {
    "name strong, address weak": "label = 1 and name_ratio >= 0.85 and addr_ratio < 0.5", "address strong, name weak": "label = 1 and addr_ratio >= 0.85 and name_ratio < 0.5", "both noisy": "label = 1 and name_ratio < 0.7 and addr_ratio < 0.7",
    "name collision": "label = 0 and name_ratio >= 0.9", "address collision": "label = 0 and addr_ratio >= 0.9", "missing name": "label = 1 and miss_n", "missing address": "label = 1 and miss_a", "several fields missing": "label = 1 and miss_n and miss_a",
    "identical after normalisation": "label = 1 and exact", "token order": "label = 1 and tsort >= 0.95 and name_ratio < 0.9", "typo": "label = 1 and jw >= 0.9 and not exact", "transliteration": "label = 1 and script >= 2", "x_true": "label = 1", "x_high_false": "label = 0 and p >= 0.3",
}


@query(f"""with {STATS_SQL}, f as (select *, p as name_ratio, (pool_id % 10) / 10.0::double as addr_ratio, least(p + 0.1::double, 1.0::double) as jw, (case when pool_id % 4 = 0 then 0.97 else 0.5 end)::double as tsort, pool_id % 5 = 0 as exact, pool_id % 3 as script, pool_id % 11 = 0 or s1_id % 13 = 0 as miss_n, pool_id % 7 = 0 as miss_a from pairs),
per as (select s1_id, sum(label) as tc, {", ".join(f'max(({v})::int) as "{k}"' for k, v in EDGES.items())} from f group by 1), src as (select s1_id, count(*) filter (is_s2) as n2, count(*) filter (not is_s2) as n3 from pairs where label = 1 group by 1),
s as (select stats.*, per.* exclude (s1_id, tc), coalesce(tc, 0) as tc, coalesce(n2, 0) as n2, coalesce(n3, 0) as n3 from stats left join per using (s1_id) left join src using (s1_id)),
cs as (select 'true singleton' as edge_case, * from s where truth_size = 0 union all select 'one match', * from s where truth_size = 1 union all select 'several matches', * from s where truth_size >= 2 union all select 'both sources', * from s where n2 > 0 and n3 > 0 union all select 'several in one source', * from s where n2 > 1 or n3 > 1
{" ".join(f"union all select '{k}', * from s where " + chr(34) + k + chr(34) + " = 1" for k in EDGES if not k.startswith("x_"))} union all select 'ambiguous', * from s where "x_true" = 1 and "x_high_false" = 1)
select edge_case, count(*) as entities, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(truth_size - tc)::bigint as blocking_failures, sum(tc - tp)::bigint as rejected_true, count(*) filter (truth_size = 0 and pred_size > 0) as singleton_failures, round(avg(f05), 6) as macro_f05 from cs group by 1""")
def edge_cases(spark, sf_dir):
    """A19, all 18 predicates; the tables hold no names, so similarities and flags are made of the ids and the score."""
    pool, pairs = F.col("pool_id"), scored_pairs(spark, sf_dir)
    flags = {"name_ratio": F.col("p"), "addr_ratio": (pool % 10) / 10.0, "name_jw": F.least(F.col("p") + 0.1, F.lit(1.0)), "name_token_sort": F.when(pool % 4 == 0, 0.97).otherwise(0.5), "name_exact_normalized": (pool % 5 == 0).cast("int"), "name_script_2": pool % 3}
    flags |= {"name_missing_1": (F.col("s1_id") % 13 == 0).cast("int"), "name_missing_2": (pool % 11 == 0).cast("int"), "addr_missing_1": F.lit(0), "addr_missing_2": (pool % 7 == 0).cast("int")}
    sources = pairs.where("label = 1").groupBy("s1_id").agg(F.count(F.when(F.col("is_s2"), 1)).alias("n_true_s2"), F.count(F.when(~F.col("is_s2"), 1)).alias("n_true_s3"))
    stats = _stats(spark, sf_dir).join(sources, "s1_id", "left").fillna(0, ["n_true_s2", "n_true_s3"])
    return report.edge_cases(pairs.withColumns(flags), stats).withColumn("macro_f05", F.round("macro_f05", 6))


@query(f"""with {PAIRS_SQL}, q as (select *, max(p) over (partition by s1_id) as top, row_number() over (partition by s1_id order by p desc, pool_id) as place from pairs) select s1_id, pool_id, round(p, 9) as p from q where place <= 3 and p >= 0.9 * top""")
def new_pair_keep(spark, sf_dir):
    """An entity's best new pairs, three at most, within nine tenths of its best."""
    return evaluate.keep_share(scored_pairs(spark, sf_dir)).select("s1_id", "pool_id", F.round("p", 9).alias("p"))


PROFILE = ("mean_name_length", "median_name_length", "p90_name_length", "nonascii_name_share", "five_digit_share", "leading_number_share")


@query(rf"""with {RAW_SQL}, d as (select source, sum(n - 1)::bigint as repeated_rows from (select source, business_name, business_address, count(*) as n from raw group by all) group by 1), p as (select source, count(*) as n_rows, count(distinct entity_id) as unique_ids, count(*) filter (business_name is null) as null_names, count(*) filter (trim(business_name) = '') as empty_names, count(*) filter (trim(business_address) = '') as empty_addresses,
avg(length(business_name)) as mean_name_length, quantile_cont(length(business_name), 0.5)::double as median_name_length, quantile_cont(length(business_name), 0.9)::double as p90_name_length, max(length(business_address))::int as max_address_length, avg(regexp_matches(business_name, '[^\x00-\x7F]')::int) as nonascii_name_share, avg(regexp_matches(business_address, '(^|[^0-9])[0-9]{{5}}([^0-9]|$)')::int) as five_digit_share, avg(regexp_matches(business_address, '^\s*[0-9]+')::int) as leading_number_share from raw group by 1)
select source, n_rows, unique_ids, null_names, empty_names, empty_addresses, max_address_length, repeated_rows, {q6(*PROFILE)} from p join d using (source)""")
def source_profile(spark, sf_dir):
    """A3-A5, A21, A24, C12, U6."""
    return report.profile(raw_records(spark, sf_dir)).select("source", "n_rows", "unique_ids", "null_names", "empty_names", "empty_addresses", "max_address_length", "repeated_rows", *r6(*PROFILE))


@query(f"with {PAIRS_SQL}, k as (select s1_id, count(*) as n from pairs where p >= 0.8 group by 1), x as (select o_orderpriority as grp, count(*) as entities, count(n) as matched_entities, coalesce(sum(n), 0)::bigint as matches from orders left join k on o_orderkey = s1_id group by 1) select grp, entities, matched_entities, matches, round(matches / nullif(matched_entities, 0)::double, 6) as matches_per_matched from x")
def inference_stats(spark, sf_dir):
    """A22."""
    required = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"), F.col("o_orderpriority").alias("grp"))
    return report.inference_stats(scored_pairs(spark, sf_dir).where("p >= 0.8"), required, "grp").withColumn("matches_per_matched", F.round("matches_per_matched", 6))


@query("select l_orderkey, bool_and(l_quantity >= 10) as all_large, round(avg((l_quantity / 51.0::double + l_discount + l_tax) / 3), 6) as mean_score from lineitem group by 1")
def all_and_mean(spark, sf_dir):
    """A conjunction by group and the mean of three scores."""
    member = (F.col("l_quantity") / 51.0 + F.col("l_discount") + F.col("l_tax")) / 3
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") >= 10).alias("all_large"), F.round(F.avg(member), 6).alias("mean_score"))


# ---- sampling and sets

def _md5(x: str, seed: int) -> str:
    return f"md5('{seed}:' || {x})"


def _share(x: str, seed: int) -> str:
    return f"('0x' || substr({_md5(x, seed)}, 1, 8))::bigint"


@query(f"select o_orderkey as s1_id, case when {_share('o_orderkey', 0)} / 4294967296.0::double < 0.15 then 'val' when {_share('o_orderkey', 0)} / 4294967296.0::double < 0.3 then 'hold' else 'train' end as part, ({_share('o_orderkey', 5)} % 5)::int as fold from orders")
def entity_split(spark, sf_dir):
    """U8, U10, U11."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id"))
    return sampling.split(rows, "s1_id").withColumn("fold", sampling.fold(F.col("s1_id"), 5, 5))


@query(f"select o_orderkey as s1_id from orders order by {_md5('o_orderkey', 3)}, o_orderkey limit 100")
def entity_sample(spark, sf_dir):
    """U7."""
    return sampling.sample(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")), "s1_id", 100, 3)


@query(f"select o_orderkey as s1_id, case when {_share('o_orderkey', 13)} / 4294967296.0::double < 0.1 then 'ce' when {_share('o_orderkey', 13)} / 4294967296.0::double < 0.1 + 0.2 then 'stack' else 'pool' end as grp from orders")
def entity_groups(spark, sf_dir):
    """U9."""
    return sampling.groups(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")), "s1_id", {"ce": 0.1, "stack": 0.2})


@query(f"""with {PAIRS_SQL}, h as (select *, row_number() over (partition by s1_id, label order by p desc, pool_id) as hard from pairs), l as (select *, row_number() over (partition by s1_id, label, hard > 1 order by {_md5("s1_id || ':' || pool_id", 0)}, pool_id) as any_ from h) select s1_id, pool_id, label from l where label = 1 or hard <= 1 or any_ <= 1""")
def negative_sampling(spark, sf_dir):
    """W14, U12."""
    return sampling.negatives(scored_pairs(spark, sf_dir), 1, 1).select("s1_id", "pool_id", "label")


@query(f"with {PAIRS_SQL}, w as (select * from pairs where s1_id not in (select o_orderkey from orders where {_share('o_orderkey', 0)} < {int(0.3 * (1 << 32))})) select pool_id, count(*) as n_claim from w group by 1")
def orphan_world(spark, sf_dir):
    """Claims left when a random share of the entities is gone."""
    return sampling.orphan_world(scored_pairs(spark, sf_dir), 0.3).groupBy("pool_id").agg(F.count(F.lit(1)).alias("n_claim"))


@query("select s_nationkey as nationkey, 'both' as side from supplier intersect select c_nationkey, 'both' from customer union all (select c_nationkey, 'customers only' from customer except select s_nationkey, 'customers only' from supplier)")
def set_operations(spark, sf_dir):
    """U4, U5."""
    s, c = (table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("nationkey")) for t in ("supplier", "customer"))
    return s.intersect(c).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


# ---- second hop, new pairs, models, stream

# the second retrieval shadows the first one's names inside its own WITH; its queries are the anchors
ANCHORED_SQL = block_sql().strip().removeprefix(",").replace("s1 as (select * from canon where source = 'S1')", "s1 as (select * from canon where id in (select anchor_id from anchors))")


@query(f"""with {RECORDS_SQL} {block_sql()}, known as (select country, s1_id, pool_id, least(round(rank_score, 9) / 2.5::double, 1.0::double) as q from ranked),
anchors as (select * from (select country, s1_id, pool_id as anchor_id, q, row_number() over (partition by country, s1_id order by q desc, pool_id) as place from known where q >= 0.3::double) where place <= 3),
again as (with {ANCHORED_SQL} select country, s1_id as anchor_id, pool_id, round(rank_score, 9) as r from ranked),
reached as (select country, a.s1_id, g.pool_id, max(struct_pack(r := g.r, c := a.q)) as b, count(*) as hop_n from anchors a join again g using (country, anchor_id) where g.pool_id <> a.anchor_id and not exists (select 1 from known k where k.country = g.country and k.s1_id = a.s1_id and k.pool_id = g.pool_id) group by 1, 2, 3)
select country, s1_id, pool_id, round(b.r, 6) as hop_rank, round(b.c, 6) as hop_conf, hop_n from (select *, row_number() over (partition by country, s1_id order by b.r desc, pool_id) as place from reached) where place <= 10""")
def second_hop(spark, sf_dir):
    """Anchors are confident candidates."""
    found, s1, pool = _linked(spark, sf_dir)
    first = found.withColumn("q", F.least(F.round("rank_score", 9) / 2.5, F.lit(1.0)))
    return hops.second_hop(hops.anchors(first, 0.3), first, pool, CFG).select("country", "s1_id", "pool_id", "hop_n", *r6("hop_rank", "hop_conf"))


@query(f"""with {PAIRS_SQL}, d as (select s1_id, pool_id, p as dense_score, (pool_id % 30)::int as dense_rank from pairs where pool_id % 2 = 0), h as (select s1_id, pool_id, p / 2 as hop_rank, p as hop_conf, 1::bigint as hop_n from pairs where pool_id % 3 = 0)
select s1_id, pool_id, (d.s1_id is not null)::int as src_dense, (h.s1_id is not null)::int as src_hop, round(dense_score, 6) as dense_score, dense_rank, round(hop_rank, 6) as hop_rank, round(hop_conf, 6) as hop_conf, hop_n from d full join h using (s1_id, pool_id)""")
def new_pair_union(spark, sf_dir):
    """A7, U3."""
    pairs = scored_pairs(spark, sf_dir)
    dense = pairs.where("pool_id % 2 = 0").select("s1_id", "pool_id", F.col("p").alias("dense_score"), (F.col("pool_id") % 30).cast("int").alias("dense_rank"))
    hop = pairs.where("pool_id % 3 = 0").select("s1_id", "pool_id", (F.col("p") / 2).alias("hop_rank"), F.col("p").alias("hop_conf"), F.lit(1).cast("long").alias("hop_n"))
    return hops.union_sources(dense, hop).select("s1_id", "pool_id", "src_dense", "src_hop", "dense_rank", "hop_n", *r6("dense_score", "hop_rank", "hop_conf"))


@query(f"with {PAIRS_SQL} select s1_id, pool_id, (s1_id % 5 = 0)::int as is_new, round(case when s1_id % 5 = 0 then 0.0 else p end, 6)::double as ov_name, round(p, 6) as filter_score from pairs")
def extended_candidates(spark, sf_dir):
    """New pairs appended with zero evidence."""
    pairs = scored_pairs(spark, sf_dir)
    first = pairs.where("s1_id % 5 <> 0").select("s1_id", "pool_id", F.col("p").alias("ov_name"), F.col("p").alias("filter_score"))
    new = pairs.where("s1_id % 5 = 0").select("s1_id", "pool_id", F.col("p").alias("new_score"))
    return hops.extend_candidates(first, new, keys=("s1_id", "pool_id")).select("s1_id", "pool_id", "is_new", *r6("ov_name", "filter_score"))


@query(f"with {PAIRS_SQL} select s1_id, pool_id, round(case when s1_id % 7 = 0 then p / 2 else p end, 6) as p from pairs")
def oof_override(spark, sf_dir):
    """C8, J9, J10."""
    pairs = scored_pairs(spark, sf_dir).select("s1_id", "pool_id", "p")
    return hops.override(pairs, pairs.where("s1_id % 7 = 0").withColumn("p", F.col("p") / 2)).select("s1_id", "pool_id", *r6("p"))


@query()
def new_pair_features(spark, sf_dir):
    """M8."""
    s1, pool = sides(spark, sf_dir)
    rows = features.with_sides(blocking.block(blocking.records(s1), blocking.records(pool), CFG), s1, pool, ("name_normalized", "address_normalized", "name_script"))
    rows = rows.select("country", "s1_id", "pool_id", "name_script_2", *[F.col(f"{c}_{s}").alias(f"{n}_{s}") for n, c in (("name", "name_normalized"), ("addr", "address_normalized")) for s in (1, 2)])
    return hops.new_pair_features(rows).drop("name_1", "name_2", "addr_1", "addr_2")


@query(f"with {LABELLED_SQL}, x as (select s1_id, pool_id, label, ov_name >= 0.999 as b1, ov_name >= 0.85 and ov_addr > 0.5 as b2, 0.5 * (ov_name + ov_addr) >= 0.68 as b3 from lab) select count(*) filter (b1) as exact_name, count(*) filter (b1 and label = 1) as exact_name_true, count(*) filter (b2) as fuzzy, count(*) filter (b2 and label = 1) as fuzzy_true, count(*) filter (b3) as mean_score, count(*) filter (b3 and label = 1) as mean_score_true from x")
def baseline_rules(spark, sf_dir):
    """P7 on overlaps: what rule baselines keep."""
    rules = {"exact_name": F.col("ov_name") >= 0.999, "fuzzy": (F.col("ov_name") >= 0.85) & (F.col("ov_addr") > 0.5), "mean_score": 0.5 * (F.col("ov_name") + F.col("ov_addr")) >= 0.68}
    return _labelled(spark, sf_dir).agg(*[F.count(F.when(r & cond, 1)).alias(n + s) for n, r in rules.items() for s, cond in (("", F.lit(True)), ("_true", F.col("label") == 1))])


MODEL_FEATURES = ("p", "e_rank", "e_sum", "e_count", "ps_rank", "ps_q", "ps_n_claim")


def _stack_frame(spark, sf_dir):
    rows = graph.pool_competition(graph.entity_context(scored_pairs(spark, sf_dir), ("s1_id",), "e_"))
    # the fixture's scores don't tell its labels; noise of the id gives models something to fit
    return rows.withColumn("label", ((F.col("p") + F.col("pool_id") % 7 / 20.0) > 0.6).cast("int"))


@query()
def matcher_logistic(spark, sf_dir):
    """Median imputation, scaling, logistic regression; fitted on a fixed split."""
    rows = sampling.split(_stack_frame(spark, sf_dir), "s1_id")
    model = models.fit(rows.where("part = 'train'"), MODEL_FEATURES, "lr")
    return models.score(model, rows.where("part <> 'train'"), MODEL_FEATURES, "lr", "score").select("s1_id", "pool_id", "part", "label", "score")


@query()
def stacker_out_of_fold(spark, sf_dir):
    """Scores by models that saw no pair of the entity's fold."""
    return models.out_of_fold(_stack_frame(spark, sf_dir), MODEL_FEATURES, 2, kind="lr", out="score").select("s1_id", "pool_id", "label", "score")


@query()
def streamed_linkage(spark, sf_dir):
    """Extension: query records as a stream against the static pool."""
    source, out, state = (io.scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    s1, pool = raw_records(spark, sf_dir).where("source = 'S1'"), sides(spark, sf_dir)[1]
    s1.write.parquet(source)
    link_stream(spark.readStream.schema(s1.schema).parquet(source), pool, out, state, CFG).awaitTermination()
    return spark.read.parquet(out).select("country", "s1_id", "pool_id", "place")


@query("select s1_id, pool_id, k from (select l_orderkey as s1_id, l_partkey as pool_id, row_number() over (partition by l_orderkey order by max(l_quantity) desc, l_partkey) as k from lineitem group by 1, 2) where k <= 3")
def top_k_cut(spark, sf_dir):
    """K2, K4, W3 with a floor that keeps the first candidates."""
    rows = blocking.select_top(scored_pairs(spark, sf_dir), "p", 3, floor=0.0, keep=1, entity=("s1_id",))
    return rows.select("s1_id", "pool_id", F.col("place").cast("long").alias("k"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def worst_rows(spark, sf_dir):
    """K3: the head of a report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)

