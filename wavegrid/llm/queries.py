"""The registered query of each operator with its production parameters, and its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavegrid.llm import chat_format, fingerprint, language_id, lm_score, mixing, ngram_join, packing, quality_rules, sharding, url_filter

#: Rules of op1, as the contract gives them.
RULES = [
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
]
#: The list of URLs that op1 looks up: numbered articles in four languages on all sites of these names.
LISTED_SITES = [f"{before}{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for before in ("", "m.", "blog.") for end in ("com", "net", "org")]
LISTED_LANGUAGES, LISTED_ARTICLES = ["de", "en", "es", "fr"], 10_000
SHARDS, SHARD_SEED = 16, 20


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed_urls(spark), RULES)


def listed_urls(spark: SparkSession) -> DataFrame:
    """The list of canonical URLs, made by rule; it does not depend on the judged pages."""
    starts = [f"{site}/{lang}/" for site in LISTED_SITES for lang in LISTED_LANGUAGES]
    urls = spark.range(LISTED_ARTICLES).select("id", F.explode(F.array(*map(F.lit, starts))).alias("start"))
    return urls.select(F.concat("start", F.col("id").cast("string")).alias("canonical_url"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sharding.shard(docs, SHARDS, SHARD_SEED)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.fold(F.col("doc_id"), 5) == 1
    out = lm_score.score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out)
    out = out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
    return out.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, threshold=85)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-1L, 0L, 'user', '{probe}'), (-1L, 1L, 'assistant', '{probe}') as t(conv_id, turn, role, text)")
    out = chat_format.format_chats(chats.unionByName(extra))
    turns = chat_format.parse_chats(F.col("formatted"))
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (
        out.withColumns({"back": turns, "loss": chat_format.loss_text(F.col("segments"))})
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = language_id.fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.where(~held_out).select("text", "lang"))
    out = language_id.classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_sharding, op3_lm_scoring, op4_fingerprints, op5_quality_rules, op6_mixing, op7_packing, op8_ngram_join, op9_chat_formatting, op10_language_id)}


_RULE_CASES = """
    case when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
         when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
         when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
         when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end"""


def oracle_sql() -> dict[str, str]:
    words = r"[^\x20\x09-\x0D]+"
    return {
        "op1_url_filters": rf"""
with u as (
  select page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_\w+|gclid|fbclid|ref)(=|$)'))) as kept
  from pages),
c as (
  select page_id, host, path, {_RULE_CASES} as rule,
    case when contains(url, '://') then
      regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '')
      || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical_url
  from u),
l as (
  select b || n || '.example.' || t || '/' || g || '/' || i as canonical_url
  from unnest(['', 'm.', 'blog.']) b(b), unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) n(n),
    unnest(['com', 'net', 'org']) t(t), unnest(['de', 'en', 'es', 'fr']) g(g), range(10000) i(i))
select page_id, host, path, rule,
  case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
       when l.canonical_url is not null then 'block' else 'allow' end as verdict,
  c.canonical_url, rule is null and l.canonical_url is not null as listed
from c left join l on c.canonical_url = l.canonical_url""",
        "op6_mixing": rf"""
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{words}')), 0)::bigint as size from documents),
s as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight
  from d group by source),
r(round, source, source_size, weight, capped, target) as (
  select 0, source, source_size, weight, false, (select 1.5 * sum(size) from d) * weight / sum(weight) over () from s
  union all
  select * from (
    select round + 1, source, source_size, weight, now_capped,
      case when now_capped then 2.0 * source_size
           else ((select 1.5 * sum(size) from d) - sum(case when now_capped then 2.0 * source_size else 0 end) over ()) * weight
                / sum(case when now_capped then 0 else weight end) over () end
    from (select *, capped or target >= 2.0 * source_size as now_capped,
            count(*) filter (not capped and target >= 2.0 * source_size) over () as fresh from r)
    where fresh > 0)),
t as (select source, source_size, target from r where round = (select max(round) from r))
select doc_id, size, source_size, target,
  (floor(rate)::bigint + case when ('0x' || substr(md5('6:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0 < rate - floor(rate) then 1 else 0 end) * size as taken
from (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
      from d join t on d.source is not distinct from t.source)""",
        "op8_ngram_join": rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingle from w where words is not null),
n as (select doc_id, count(*) as size from s group by doc_id),
rare as (select shingle from s group by shingle having count(*) > 1),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from (select * from s semi join rare using (shingle)) a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by 1, 2),
e as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.size + y.size - common)),
both_ways as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from both_ways union select reach.a, both_ways.b from reach join both_ways on reach.b = both_ways.a)
select d.doc_id, coalesce(n.size, 0)::bigint as n_shingles, least(d.doc_id, coalesce(r.least_id, d.doc_id)) as component_id, coalesce(l.n_links, 0) as n_links
from documents d left join n on d.doc_id = n.doc_id left join (select a, min(b) as least_id from reach group by a) r on d.doc_id = r.a
  left join (select a, count(*) as n_links from both_ways group by a) l on d.doc_id = l.a""",
        "op9_chat_formatting": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (select *, lag(role) over w as before, row_number() over w as n, count(*) over (partition by conv_id) as m
      from c window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('<|im_end|>') + 1)::bigint as formatted_chars,
  bool_and(coalesce(case when n = 1 then role in ('system', 'user') when before in ('system', 'assistant') then role = 'user' when before = 'user' then role = 'assistant' else false end, false)
    and (n < m or role = 'assistant')) as valid
from p group by conv_id""",
    }
