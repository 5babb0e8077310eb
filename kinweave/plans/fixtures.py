"""How the operators' roles are bound to the driver's tables, in DataFrames and as SQL.

``documents`` are the records to link: a document's language is its country,
its source number makes it a query (S1) or pool record (S2, S3), its first
eight words are the name and the next sixteen the address. ``lineitem`` is the
graph of scored pairs: orders claim parts with a score from the quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ADDRESS_WORDS, LEGAL_TOKENS, NAME_WORDS, normalize_records
from ..operators.blocking import Config
from ..sources.io import materialize

#: Caps scaled to the fixture, so that they cut.
CFG = Config(df_cap=20, exact_cap=20, name_bigram_cap=20, address_bigram_cap=20, prefix_cap=20, max_candidates=10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the split stops after the words that are used; the rest of a long text stays one piece
    words = F.slice(F.filter(F.split("text", r"\s+", 26), lambda w: w != ""), 1, 24)
    number = F.substring("source", 4, 9).cast("int")
    tag = F.when(number <= 4, "S1").when(number <= 12, "S2").otherwise("S3")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("country"), tag.alias("source"), words.alias("w"))
    return docs.select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.array_join(F.slice("w", 1, 8), " ").alias("business_name"), F.array_join(F.slice("w", 9, 16), " ").alias("business_address"), "country", "source")


def linkage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_records(raw_records(spark, sf_dir))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # retrieval reads the records once for each rule and side, so they are normalised once
    found = materialize(linkage_records(spark, sf_dir), "records")
    return found.where("source = 'S1'"), found.where("source <> 'S1'")


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("s1_id"), F.col("l_partkey").alias("pool_id")).agg((F.max("l_quantity") / 51.0).alias("p"), (F.max("l_returnflag") == "R").alias("is_s2"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("label"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, with the number of their true pairs."""
    sizes = scored_pairs(spark, sf_dir).groupBy("s1_id").agg(F.sum("label").alias("truth_size"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_id")).join(sizes, "s1_id", "left").select("s1_id", F.coalesce("truth_size", F.lit(0)).alias("truth_size"))


RAW_SQL = r"""
docs as (
  select doc_id, lang as country, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')[1:24] as w,
         case when substr(source, 4)::int <= 4 then 'S1' when substr(source, 4)::int <= 12 then 'S2' else 'S3' end as source
  from documents
), raw as (
  select source || '-' || doc_id as entity_id, array_to_string(w[1:8], ' ') as business_name, array_to_string(w[9:24], ' ') as business_address, country, source from docs
)"""


def words_sql(x: str, contractions: dict[str, str]) -> str:
    cleaned = rf"trim(regexp_replace(regexp_replace(replace(lower(strip_accents(coalesce({x}, ''))), '&', ' and '), '[^\p{{L}}\p{{N}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in contractions.items())
    return f"list_transform(list_filter(string_split({cleaned}, ' '), lambda t: t <> ''), lambda t: case t {cases} else t end)"


RECORDS_SQL = (
    RAW_SQL
    + f"""
, split as (
  select *, {words_sql("business_name", NAME_WORDS)} as name_tokens, {words_sql("business_address", ADDRESS_WORDS)} as address_tokens from raw
), recs as (
  select entity_id, country, source, business_name as name_original, business_address as address_original, name_tokens, address_tokens,
         array_to_string(name_tokens, ' ') as name_normalized, array_to_string(name_tokens, '') as name_compact,
         array_to_string(list_sort(name_tokens), ' ') as name_sorted_tokens,
         array_to_string(list_filter(name_tokens, lambda t: t not in ({", ".join(f"'{t}'" for t in LEGAL_TOKENS)})), ' ') as name_core,
         array_to_string(address_tokens, ' ') as address_normalized, array_to_string(address_tokens, '') as address_compact,
         array_to_string(list_sort(address_tokens), ' ') as address_sorted_tokens,
         coalesce(nullif(regexp_extract(business_address, '(?:^|[^0-9])([0-9]{{6}})(?:[^0-9]|$)', 1), ''),
                  nullif(regexp_extract(business_address, '(?:^|[^0-9])([0-9]{{5}})(?:-[0-9]{{4}})?(?:[^0-9]|$)', 1), '')) as postal_code,
         nullif(lower(regexp_extract(business_address, '^\\s*([0-9]+[a-z]?)\\b', 1)), '') as house_number
  from split
)"""
).replace("\\\\", "\\")

PAIRS_SQL = """
pairs as (
  select l_orderkey as s1_id, l_partkey as pool_id, max(l_quantity) / 51.0::double as p, max(l_returnflag) = 'R' as is_s2,
         max(case when l_linestatus = 'F' then 1 else 0 end) as label
  from lineitem group by 1, 2
), required as (
  select o_orderkey as s1_id, coalesce(t.truth_size, 0) as truth_size
  from orders left join (select s1_id, sum(label)::bigint as truth_size from pairs group by 1) t on o_orderkey = t.s1_id
)"""


def block_sql(cfg: Config = CFG) -> str:
    """CTEs ``s1, pool, evidence, ranked`` after RECORDS_SQL."""
    zeros = "list_transform({0}, lambda t: regexp_replace(t, '^0+([0-9])', '\\1'))"
    out = f"""
, canon as (
  select entity_id as id, country, source, {zeros.format("name_tokens")} as nt, {zeros.format("address_tokens")} as at_, name_normalized, name_compact,
         replace(name_core, ' ', '') as core, postal_code
  from recs
), s1 as (select * from canon where source = 'S1'), pool as (select * from canon where source <> 'S1'),
n_pool as (select country, count(*) as n from pool group by 1)"""
    for f, col, k in (("name", "nt", cfg.k_name), ("addr", "at_", cfg.k_address)):
        out += f"""
, {f}_post as (select country, id, unnest(list_distinct({col})) as token from pool),
{f}_df as (select p.country, token, count(*) as df, any_value(n) as n, ln((any_value(n) + 1.0::double) / (count(*) + 1.0::double)) as idf from {f}_post p join n_pool using (country) group by 1, 2),
{f}_pick as (
  select country, id, token, idf from (
    select q.country, q.id, q.token, d.idf, row_number() over (partition by q.country, q.id order by d.df, q.token) as place
    from (select country, id, unnest(list_distinct({col})) as token from s1) q join {f}_df d using (country, token) where d.df <= {cfg.df_cap}
  ) where place <= {k}
), {f}_hits as (select q.country, q.id as s1_id, p.id as pool_id, count(*) as n, sum(q.idf) as w from {f}_pick q join {f}_post p using (country, token) group by 1, 2, 3)"""
    bigrams = "select country, id, unnest(list_transform(range(1, len({0})), lambda i: least({0}[i], {0}[i + 1]) || ' ' || greatest({0}[i], {0}[i + 1]))) as key from {1}"
    families = {"full": ("select country, id, name_normalized as key from {1} where name_normalized <> ''", cfg.exact_cap), "comp": ("select country, id, name_compact as key from {1} where name_compact <> ''", cfg.exact_cap),
                "post": ("select country, id, postal_code as key from {1} where postal_code is not null", cfg.exact_cap), "nb": (bigrams.replace("{0}", "nt"), cfg.name_bigram_cap), "ab": (bigrams.replace("{0}", "at_"), cfg.address_bigram_cap),
                "px": (f"select country, id, substr(core, 1, {cfg.prefix_lengths[0]}) as key from {{1}} where length(core) >= {cfg.prefix_lengths[0]}", cfg.prefix_cap)}
    for f, (sql, cap) in families.items():
        out += f"""
, {f}_p as ({sql.replace("{1}", "pool")}), {f}_q as ({sql.replace("{1}", "s1")}),
{f}_ok as (select country, key from {f}_p group by 1, 2 having count(*) <= {cap}),
{f}_hits as (select q.country, q.id as s1_id, p.id as pool_id, count(*) as n from {f}_q q join {f}_ok using (country, key) join {f}_p p using (country, key) group by 1, 2, 3)"""
    rules = " union all ".join([f"select country, s1_id, pool_id, '{f}' as rule, n, w from {f}_hits" for f in ("name", "addr")] + [f"select country, s1_id, pool_id, '{f}_' as rule, n, 0.0::double from {f}_hits" for f in families])

    def total(rule: str, col: str = "n", zero: str = "0") -> str:
        return f"sum(case when rule = '{rule}' then {col} else {zero} end)" + ("::bigint" if col == "n" else "")

    out += f"""
, rules as ({rules}), evidence_ as (
  select country, s1_id, pool_id, {total("name")} as n_name_shared, {total("addr")} as n_addr_shared, {total("name", "w", "0.0::double")} as idf_name, {total("addr", "w", "0.0::double")} as idf_addr,
         least({total("full_")}, 1)::bigint as exact_name, least({total("comp_")}, 1)::bigint as exact_compact, least({total("post_")}, 1)::bigint as postal_eq,
         {total("ab_")} as n_addr_bigram, {total("nb_")} as n_name_bigram, least({total("px_")}, 1)::bigint as n_prefix
  from rules group by 1, 2, 3
), evidence as (
  select *, ((n_name_shared > 0)::int + (n_addr_shared > 0)::int + exact_name + exact_compact + postal_eq + (n_addr_bigram > 0)::int + (n_name_bigram > 0)::int + (n_prefix > 0)::int)::bigint as n_strategies,
         idf_name + idf_addr + 6.0::double * exact_name + 4.0::double * exact_compact + 3.0::double * postal_eq as block_score
  from evidence_
)"""
    for f, col, width in (("name", "nt", cfg.width_name), ("addr", "at_", cfg.width_address)):
        out += f"""
, {f}_cells as (select country, id, source, generate_subscripts({col}, 1) as pos, unnest({col}) as token from canon),
{f}_w as (select c.*, d.idf, coalesce(d.idf, ln(m.n + 1.0::double)) as w from {f}_cells c left join {f}_df d using (country, token) join n_pool m using (country)),
{f}_mass as (select country, id, sum(w) as mass from {f}_w group by 1, 2),
{f}_known as (select * from (select *, row_number() over (partition by country, id order by pos) as slot from {f}_w where idf is not null) where slot <= {width}),
{f}_shared as (
  select e.country, e.s1_id, e.pool_id, sum(k.idf) as s from evidence e join {f}_known k on k.country = e.country and k.id = e.s1_id
  where exists (select 1 from {f}_known h where h.country = e.country and h.id = e.pool_id and h.token = k.token) group by 1, 2, 3
)"""
    out += f"""
, over as (
  select e.*, coalesce(case when coalesce(m1.mass, 0) + coalesce(m2.mass, 0) > 0 then 2.0::double * coalesce(ns.s, 0) / (coalesce(m1.mass, 0) + coalesce(m2.mass, 0)) end, 0.0::double) as ov_name,
         coalesce(case when coalesce(a1.mass, 0) + coalesce(a2.mass, 0) > 0 then 2.0::double * coalesce(as_.s, 0) / (coalesce(a1.mass, 0) + coalesce(a2.mass, 0)) end, 0.0::double) as ov_addr
  from evidence e
  left join name_mass m1 on m1.country = e.country and m1.id = e.s1_id left join name_mass m2 on m2.country = e.country and m2.id = e.pool_id
  left join addr_mass a1 on a1.country = e.country and a1.id = e.s1_id left join addr_mass a2 on a2.country = e.country and a2.id = e.pool_id
  left join name_shared ns on ns.country = e.country and ns.s1_id = e.s1_id and ns.pool_id = e.pool_id
  left join addr_shared as_ on as_.country = e.country and as_.s1_id = e.s1_id and as_.pool_id = e.pool_id
), ranked as (
  select * from (select *, ov_name + 1.5::double * ov_addr as rank_score, row_number() over (partition by country, s1_id order by round(ov_name + 1.5::double * ov_addr, 9) desc, pool_id) as place from over)
  where place <= {cfg.max_candidates}
)"""
    return out
