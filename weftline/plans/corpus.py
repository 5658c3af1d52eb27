"""Queries of the corpus pipeline, with the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.text import collapse_space, redact, token_estimate
from weftline.operators import blend, checks, ingest, postprocess, sequences, shuffle, tokens
from weftline.operators.prefix import ordinals, prefix_sum
from weftline.operators.spread import spread
from weftline.plans.sqltext import SPACE, cleaned, collapsed, quoted
from weftline.scratch import cut

MIN_CHARS, MAX_CHARS, RATE = 200, 2000, 0.1
ORDER = ["file_idx", "line_no"]
SEED, BUCKETS = 20260724, 64
SHARD = 5000
CHUNK = 2000
TOTAL = 100_000_000_000
CAP = 4000
LENGTH = 128
SECRETS = ("password", "secret", "token", "warmup")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def source(column: str = "source") -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(column)), F.lit("")), F.lit("unknown"))


def clean_dedup_split(spark: SparkSession, d: str) -> DataFrame:
    """Raw records cleaned, length-filtered, first of each hash kept, split by hash."""
    kept = postprocess.processed(table(spark, d, "raw_records"), ORDER, MIN_CHARS, MAX_CHARS, RATE, keep=("record_id",))
    return kept.select("record_id", "text", source("source_id").alias("source"), "document_hash", "split")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.reasons(table(spark, d, "raw_records"), ORDER, MIN_CHARS, MAX_CHARS, RATE)


def postprocess_stats(spark: SparkSession, d: str) -> DataFrame:
    return postprocess.statistics(_judged(spark, d))


def stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).groupBy(source("source_id").alias("source"), "outcome").agg(F.count("*").alias("documents"))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return blend.plan(table(spark, d, "general_100b_mix").where("split = 'train'"), TOTAL)


def blend_allocation(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("id", "weight", "target_tokens", "split", "text_field")


def download_tasks(spark: SparkSession, d: str) -> DataFrame:
    return blend.tasks(_plan(spark, d), 4, 1.15)


def download_shards(spark: SparkSession, d: str) -> DataFrame:
    """Part 1 of 4 of each source, its first two rows already fetched."""
    rows = table(spark, d, "documents").select(source().alias("source"), "doc_id")
    return ingest.shard(ordinals(rows, ["doc_id"], "ordinal", ["source"]), "ordinal", 4, 1, 2)


def download_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source until 20,000 estimated tokens are reached; the one that crosses is kept."""
    rows = table(spark, d, "documents").select(source().alias("source"), "doc_id", token_estimate(F.col("text")).alias("estimate"))
    return ingest.within_budget(rows, ["doc_id"], F.col("estimate"), F.lit(20_000), ["source"])


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("download_id").agg(F.count("*").alias("documents"), F.sum(token_estimate(F.col("text"))).alias("tokens"))


def download_stats(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots per download: the latest counts, and how it ended."""
    rows = table(spark, d, "resume_snapshots")
    last = lambda c: F.max_by(c, F.struct("updated_at", "snapshot_id")).alias(c)
    return rows.groupBy("download_id").agg(F.count("*").alias("snapshots"), F.countDistinct("updated_at").alias("distinct_snapshots"), F.max("scanned_documents").alias("most_scanned"), last("status"), last("estimated_tokens"), last("stop_reason"))


def _shuffled(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed_records").select("record_id", "split", "source_id", "document_hash")
    numbered = rows.join(ordinals(rows, ["record_id"], "ordinal", ["split"]), ["split", "record_id"])
    return shuffle.keyed(numbered.withColumn("document_hash", F.coalesce("document_hash", F.concat(F.lit("record:"), F.col("record_id")))), SEED, BUCKETS)


def processed_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """The place of each processed record in its split's shuffled order."""
    keyed = _shuffled(spark, d)
    placed = ordinals(keyed, ["bucket_key", "key"], "place", ["split"])
    return keyed.join(placed, ["split", "bucket_key", "key"]).select("record_id", "split", "bucket", "key", "place")


def shuffle_buckets(spark: SparkSession, d: str) -> DataFrame:
    sizes = _shuffled(spark, d).groupBy("split", "bucket").agg(F.count("*").alias("n"))
    return sizes.groupBy("split").agg(F.sum("n").alias("documents"), F.count("*").alias("buckets"), F.max("n").alias("largest"))


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "documents").select(source().alias("source"), "doc_id", "text"))
    return rows.select("source", "doc_id", tokens.word_length_tokens(F.col("text")).alias("tokens"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.size("tokens").cast("long")).alias("tokens"))


def _addressed(spark: SparkSession, d: str) -> DataFrame:
    sized = cut(_encoded(spark, d).select("source", "doc_id", F.size("tokens").cast("long").alias("n")), "sized")  # range partitioning reads it twice
    return sized.select("source", "doc_id").join(prefix_sum(sized, ["doc_id"], "n"), "doc_id")


def token_shards(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source in each shard; documents may lie across shards."""
    return tokens.shard_pieces(_addressed(spark, d), SHARD).groupBy("shard", "source").agg(F.sum("taken").alias("tokens"))


def train_token_cap(spark: SparkSession, d: str) -> DataFrame:
    """Training records that a greedy cap of each source accepts."""
    rows = table(spark, d, "processed_records").where("split = 'train'").select(source("source_id").alias("source_id"), "record_id", F.size(tokens.word_length_tokens(F.col("text"))).cast("long").alias("n"))
    limits = table(spark, d, "general_100b_mix").where("split = 'train' and enabled").select(F.lower("id").alias("source"), F.lit(CAP).cast("long").alias("most"))
    return tokens.capped(rows, limits, ["record_id"])


def split_of(column: str = "split") -> Column:
    """The split of a record; one without a split is train."""
    return F.coalesce(column, F.lit("train"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """(split, record_id, tokens, start) of all processed records; each split is a stream of its own."""
    records = table(spark, d, "processed_records").withColumn("split", split_of())
    rows = cut(spread(records.select("split", "record_id", "text")).select("split", "record_id", tokens.word_length_tokens(F.col("text")).alias("tokens")), "tokens")
    starts = prefix_sum(rows.select("split", "record_id", F.size("tokens").cast("long").alias("n")), ["record_id"], "n", by=["split"])
    return rows.join(starts, ["split", "record_id"])


def next_token(spark: SparkSession, d: str) -> DataFrame:
    """Every token of every split with its address and the token after it."""
    return sequences.labelled(_stream(spark, d), ["split"])


def sequence_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every whole training sequence of every split, tokens and labels."""
    packed = sequences.packed(_stream(spark, d), LENGTH, by=["split"])
    return packed.select("split", "sequence", F.array_join("input_ids", ",").alias("input_ids"), F.array_join("labels", ",").alias("labels"))


def vocab_check(spark: SparkSession, d: str) -> DataFrame:
    """The largest token id of each split."""
    records = table(spark, d, "processed_records").select(split_of().alias("split"), tokens.word_length_tokens(F.col("text")).alias("tokens"))
    return sequences.largest_token(records, ["split"])


def _shards(spark: SparkSession, d: str) -> DataFrame:
    """Shards once each: rows sent twice are equal."""
    rows = table(spark, d, "token_shards").select("shard_id", "source_token_counts")
    return rows.groupBy("shard_id").agg(F.first("source_token_counts").alias("source_token_counts"))


def source_count_maps(spark: SparkSession, d: str) -> DataFrame:
    return shuffle.source_counts(_shards(spark, d))


def token_chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """Runs of sources cut into chunks; in a shard sources lie as they first appear over all shards."""
    runs = shuffle.with_first(shuffle.source_counts(_shards(spark, d)), "shard_id")
    return shuffle.chunks(runs, CHUNK, ["shard_id"], ["first", "source"])


def balanced_chunk_schedule(spark: SparkSession, d: str) -> DataFrame:
    return shuffle.schedule(token_chunk_plan(spark, d), SEED, ["shard_id"])


def shard_audit(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each shard row's metadata."""
    rows = table(spark, d, "token_shards")
    counted = F.aggregate(F.map_values("source_token_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    checks = [("tokens", F.coalesce(F.col("tokens") != counted, F.lit(True))), ("dtype", F.coalesce(F.col("dtype") != "uint32", F.lit(True))), ("byte_order", F.coalesce(F.col("byte_order") != "little", F.lit(True))), ("sha256", ~F.coalesce(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)))]
    wrong = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return rows.groupBy("shard_id", F.array_join(wrong, ",").alias("wrong")).agg(F.count("*").alias("rows"))


def shard_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every address with the shard that holds it."""
    shards = shuffle.source_counts(_shards(spark, d)).groupBy("shard_id").agg(F.sum("tokens").alias("tokens"))
    addressed = shards.select("shard_id").join(prefix_sum(shards, ["shard_id"], "tokens", "offset"), "shard_id")
    end = addressed.agg(F.max(F.col("offset") + F.col("tokens"))).first()[0] or 0
    return tokens.locate(spark.range(0, end).withColumnRenamed("id", "position"), addressed).select("position", "shard_id", "place")


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source that contain any of a list of strings."""
    hit = F.lit(False)
    for s in SECRETS:
        hit = hit | F.contains("text", F.lit(s))
    return table(spark, d, "documents").groupBy(source().alias("source")).agg(F.count_if(hit).alias("documents"), F.bool_or(hit).alias("found"))


def failure_redaction(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts as failure details, with what must not leave replaced."""
    return table(spark, d, "raw_records").select("record_id", redact(F.concat(F.lit("job-0a1b2c3d at api.internal token=abc /private/x "), F.coalesce("text", F.lit("")))).alias("detail"))


def white_space(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose white space cleaning changes, by source."""
    changed = collapse_space(F.col("text")) != F.col("text")
    return spread(table(spark, d, "documents").select("source", "text")).groupBy(source().alias("source")).agg(F.count_if(changed).alias("changed"), F.sum(F.char_length(collapse_space(F.col("text"))).cast("long")).alias("chars"))


def file_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Records of each file that are the first with their hash in it, as a download keeps them."""
    rows = postprocess.with_cleaned(table(spark, d, "raw_records")).where("cleaned <> ''").select("file_idx", "line_no", "digest")
    return postprocess.keep_first(rows, ["file_idx", "digest"], ["line_no"]).groupBy("file_idx").agg(F.count("*").alias("kept"), F.max("line_no").alias("last_line"))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Small text functions over raw records: truncation, the first number, a clock, ids that name nothing outside, whole numbers, splits, sets."""
    t = F.coalesce("text", F.lit(""))
    head = F.substring(t, 1, 12)
    letters = F.array_sort(F.array_distinct(F.split(F.lower(F.substring(F.regexp_replace(t, "[^a-zA-Z]", ""), 1, 6)), "")))
    return table(spark, d, "raw_records").select(
        "record_id",
        text.truncate(t, 40).alias("short"),
        text.number_in(F.substring(t, 1, 200)).alias("number"),
        text.clock(F.char_length(t)).alias("clock"),
        text.safe_id(F.regexp_replace(head, " ", "/")).alias("safe"),
        checks.whole_number(F.regexp_extract(t, "[0-9.+-]+", 0), 1).alias("whole"),
        text.normal_split(F.col("source_id"), ("code", "math")).alias("split"),
        text.first_text(F.col("source_id"), F.lit("none")).alias("named"),
        checks.same_set(letters, F.reverse(letters)).alias("same"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        clean_dedup_split, postprocess_stats, stats_by_source, blend_allocation, download_tasks, download_shards, download_budget_prefix, token_estimates, download_stats,
        processed_shuffle, shuffle_buckets, token_counts, token_shards, train_token_cap, next_token, sequence_packing, vocab_check, source_count_maps, token_chunk_plan,
        file_dedup, text_functions, balanced_chunk_schedule, shard_audit, shard_lookup, secret_scan, failure_redaction, white_space,
    )
}

_SOURCE = "coalesce(nullif(lower(trim({})), ''), 'unknown')"
_DOC = _SOURCE.format("source")
_REC = _SOURCE.format("source_id")
_EST = "greatest(1, length(text) // 4)"

_JUDGED = f"""
with c as (
  select *, coalesce(text_preprocessed, false) and coalesce(regexp_full_match(document_hash, '[0-9a-fA-F]{{64}}'), false) and text is not null as trusted from raw_records
), h as (
  select *, case when trusted then text else {cleaned("text")} end as cleaned from c
), g as (
  select *, case when trusted then document_hash else sha256(cleaned) end as digest,
         case when cleaned is null or length(cleaned) < {MIN_CHARS} then 'short' when length(cleaned) > {MAX_CHARS} then 'long' end as drop_reason from h
), n as (
  select *, case when drop_reason is null then row_number() over (partition by digest, drop_reason is null order by file_idx, line_no) end as nth from g
), j as (
  select *, coalesce(drop_reason, case when nth > 1 then 'duplicate' when cast(cast('0x' || substr(digest, 1, 16) as ubigint) as double) / 18446744073709551615.0 < {RATE} then 'validation' else 'train' end) as outcome from n
)"""

_WORDS = f"list_filter(string_split({collapsed('text')}, ' '), lambda w: w <> '')"
_TOKENS = f"list_append(list_transform({_WORDS}, lambda w: cast(length(w) as bigint)), 0)"

_STREAMS = f"""
with r as (select coalesce(split, 'train') as split, record_id, {_TOKENS} as t from processed_records),
s as (select split, record_id, t, coalesce(sum(len(t)) over (partition by split order by record_id rows between unbounded preceding and 1 preceding), 0) as start from r),
p as (select split, cast(start + i as bigint) as position, t[i + 1] as token from (select split, start, t, unnest(range(len(t))) as i from s)),
l as (select split, position, token, lead(token) over (partition by split order by position) as label from p)"""

_SHARDS = """
with o as (select shard_id, any_value(source_token_counts) as m from token_shards group by 1),
e as (select shard_id, coalesce(nullif(trim(k), ''), 'unknown') as source, m[k] as v from (select shard_id, m, unnest(map_keys(m)) as k from o)),
c as (select shard_id, source, cast(sum(v) as bigint) as tokens from e group by 1, 2 having sum(v) > 0)"""

_CHUNKS = (
    _SHARDS
    + f""", f as (select *, min(shard_id) over (partition by source) as first from c),
s as (select *, coalesce(sum(tokens) over (partition by shard_id order by first, source rows between unbounded preceding and 1 preceding), 0) as start from f),
k as (select shard_id, source, tokens, cast(start as bigint) as start, unnest(range((tokens - 1) // {CHUNK} + 1)) as chunk from s),
u as (select shard_id, source, chunk, start + chunk * {CHUNK} as "offset", least({CHUNK}, tokens - chunk * {CHUNK}) as tokens from k)"""
)

_KEYED = f"""
with o as (select *, row_number() over (partition by split order by record_id) - 1 as ordinal from processed_records),
k as (select record_id, split, sha256(concat_ws(chr(0), '{SEED}', split, cast(ordinal as varchar), coalesce(nullif(trim(document_hash), ''), 'record:' || record_id))) as key from o),
b as (select *, cast(cast('0x' || substr(key, 1, 16) as ubigint) % {BUCKETS} as integer) as bucket from k)"""

def redacted(rows: str) -> str:
    """SQL of (record_id, detail): the text x of (record_id, x) ``rows`` redacted."""
    return rf"""
with t as ({rows}),
a as (select record_id, regexp_replace(x, '(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g') as x from t),
b as (select record_id, regexp_replace(x, '\bsk-[A-Za-z0-9_-]{{8,}}', '[redacted-api-key]', 'g') as x from a),
c as (select record_id, regexp_replace(x, '(?i)\b(token|secret|password|cookie)=([^\s;]+)', '\1=[redacted]', 'g') as x from b),
e as (select record_id, regexp_replace(x, '/(?:secure|mnt/course-data|course-data|private)(?:/[^\s''"<>)]*)?', '[private-path]', 'g') as x from c),
f as (select record_id, regexp_replace(x, '\b(?:api|backend)\.internal\b', '[internal-host]', 'g') as x from e),
g as (select record_id, regexp_replace(x, '\b(?:provider-)?job-[0-9a-fA-F-]{{8,}}\b', '[provider-job]', 'g') as x from f),
h as (select record_id, array_to_string(list_filter(list_transform(string_split_regex(x, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_replace(l, {quoted(SPACE + "$")}, '')), lambda l: l <> ''), chr(10)) as x from g)
select record_id, case when length(x) > 4000 then regexp_replace(substr(x, 1, 3997), {quoted(SPACE + "$")}, '') || '...' else x end as detail from h"""


SQL = {
    "file_dedup": _JUDGED + " select file_idx, count(*) as kept, max(first) as last_line from (select file_idx, digest, min(line_no) as first from g where cleaned <> '' group by 1, 2) group by 1",
    "text_functions": r"""
with t as (select record_id, source_id, coalesce(text, '') as t from raw_records),
x as (select *, regexp_extract(t, '[0-9.+-]+', 0) as n, replace(substr(t, 1, 12), ' ', '/') as h from t)
select record_id, case when length(t) > 40 then substr(t, 1, 37) || '...' else t end as short, try_cast(nullif(regexp_extract(substr(t, 1, 200), '[0-9]+', 0), '') as bigint) as number,
 printf('%02d:%02d:%02d', length(t) // 3600, length(t) % 3600 // 60, length(t) % 60) as clock, regexp_full_match(h, '[A-Za-z0-9][A-Za-z0-9._/-]*') and not regexp_matches(h, '(^|/)\.\.?(/|$)') as safe,
 case when regexp_full_match(n, '[+-]?[0-9]+') and try_cast(n as bigint) >= 1 then try_cast(n as bigint) end as whole, case when lower(trim(source_id)) in ('code', 'math') then lower(trim(source_id)) else 'train' end as split,
 coalesce(nullif(trim(source_id), ''), 'none') as named, true as same from x""",
    "clean_dedup_split": _JUDGED + f" select record_id, cleaned as text, {_REC} as source, digest as document_hash, outcome as split from j where outcome in ('train', 'validation')",
    "postprocess_stats": _JUDGED
    + """ select count(*) as input_documents, count(*) filter (outcome = 'train') as kept_train_documents, count(*) filter (outcome = 'validation') as kept_validation_documents,
 count(*) filter (outcome = 'short') as dropped_short_documents, count(*) filter (outcome = 'long') as dropped_long_documents, count(*) filter (outcome = 'duplicate') as dropped_duplicate_documents,
 count(*) filter (trusted) as trusted_preprocessed_documents from j""",
    "stats_by_source": _JUDGED + f" select {_REC} as source, outcome, count(*) as documents from j group by 1, 2",
    "blend_allocation": f"""
with s as (select *, {float(TOTAL)} * (weight / sum(weight) over ()) as share from general_100b_mix where split = 'train' and coalesce(enabled, true)),
f as (select *, cast(floor(share) as bigint) as low from s),
r as (select *, row_number() over (order by share - low desc, id desc) as nth, {TOTAL} - sum(low) over () as spare from f)
select id, weight, low + case when nth <= spare then 1 else 0 end as target_tokens, coalesce(split, 'train') as split, coalesce(text_field, 'text') as text_field from r""",
    "download_tasks": f"""
with s as (select *, {float(TOTAL)} * (weight / sum(weight) over ()) as share from general_100b_mix where split = 'train' and coalesce(enabled, true)),
f as (select *, cast(floor(share) as bigint) as low from s),
r as (select *, row_number() over (order by share - low desc, id desc) as nth, {TOTAL} - sum(low) over () as spare from f),
t as (select id, greatest(1, cast(floor(cast(low + case when nth <= spare then 1 else 0 end as double) * 1.15) as bigint)) as budget from r),
p as (select id, budget, cast(part as integer) as part, budget // 4 + case when part < budget % 4 then 1 else 0 end as n from t, range(4) as x(part))
select id, printf('%s.part%03d', id, part) as download_id, part, case when n <= 0 then 0 end as max_docs, case when n > 0 then n end as max_tokens from p""",
    "download_shards": f"""
with o as (select {_DOC} as source, doc_id, row_number() over (partition by {_DOC} order by doc_id) - 1 as ordinal from documents)
select source, doc_id, ordinal from o where ordinal % 4 = 1 and ordinal // 4 >= 2""",
    "download_budget_prefix": f"""
with e as (select {_DOC} as source, doc_id, {_EST} as estimate from documents),
b as (select *, coalesce(sum(estimate) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from e)
select source, doc_id, estimate from b where before < 20000""",
    "token_estimates": f"select download_id, count(*) as documents, cast(sum({_EST}) as bigint) as tokens from documents group by 1",
    "download_stats": """
select download_id, count(*) as snapshots, count(distinct updated_at) as distinct_snapshots, max(scanned_documents) as most_scanned,
 last(status order by updated_at, snapshot_id) as status, last(estimated_tokens order by updated_at, snapshot_id) as estimated_tokens, last(stop_reason order by updated_at, snapshot_id) as stop_reason
from resume_snapshots group by 1""",
    "processed_shuffle": _KEYED
    + f" select record_id, split, bucket, key, row_number() over (partition by split order by sha256(concat_ws(chr(0), '{SEED}', split, 'bucket', cast(bucket as varchar))), key) - 1 as place from b",
    "shuffle_buckets": _KEYED + ", n as (select split, bucket, count(*) as n from b group by 1, 2) select split, cast(sum(n) as bigint) as documents, count(*) as buckets, max(n) as largest from n group by 1",
    "token_counts": f"select {_DOC} as source, count(*) as documents, cast(sum(len({_WORDS}) + 1) as bigint) as tokens from documents group by 1",
    "token_shards": f"""
with n as (select {_DOC} as source, doc_id, len({_WORDS}) + 1 as n from documents),
s as (select *, coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as start from n),
p as (select source, cast(start as bigint) as start, n, unnest(range(cast(start // {SHARD} as bigint), cast((start + n - 1) // {SHARD} + 1 as bigint))) as shard from s)
select shard, source, cast(sum(least(start + n, (shard + 1) * {SHARD}) - greatest(start, shard * {SHARD})) as bigint) as tokens from p group by 1, 2""",
    "train_token_cap": f"""
with recursive t as (select {_REC} as source_id, record_id, len({_WORDS}) + 1 as n from processed_records where split = 'train'),
l as (select lower(id) as source from general_100b_mix where split = 'train' and enabled),
o as (select t.*, row_number() over (partition by source_id order by record_id) as k from t where source_id in (select source from l)),
f as (
  select source_id, record_id, n, k, n <= {CAP} as taken, case when n <= {CAP} then n else 0 end as used from o where k = 1
  union all
  select o.source_id, o.record_id, o.n, o.k, f.used + o.n <= {CAP}, f.used + case when f.used + o.n <= {CAP} then o.n else 0 end from f join o on o.source_id = f.source_id and o.k = f.k + 1
)
select source_id, record_id, n from f where taken union all select source_id, record_id, n from t where source_id not in (select source from l)""",
    "next_token": _STREAMS + " select split, position, token, label from l",
    "sequence_packing": _STREAMS
    + f""", q as (select split, position // {LENGTH} as sequence, string_agg(cast(token as varchar), ',' order by position) as input_ids, string_agg(cast(label as varchar), ',' order by position) as labels, count(label) as n from l where label is not null group by 1, 2)
select split, sequence, input_ids, labels from q where n = {LENGTH}""",
    "vocab_check": _STREAMS + " select split, max(token) as largest from l group by 1",
    "source_count_maps": _SHARDS + " select shard_id, source, tokens from c",
    "token_chunk_plan": _CHUNKS + ' select shard_id, source, chunk, "offset", tokens from u',
    "balanced_chunk_schedule": _CHUNKS
    + f""", h as (select *, sha256(concat_ws(chr(0), '{SEED}', source, cast(shard_id as varchar), cast("offset" as varchar))) as h from u),
b as (select *, coalesce(sum(tokens) over (partition by source order by h rows between unbounded preceding and 1 preceding), 0) as before, sum(tokens) over (partition by source) as whole from h)
select shard_id, source, chunk, "offset", tokens, row_number() over (order by cast(2 * before + tokens as double) / cast(2 * whole as double), h) - 1 as step from b""",
    "shard_audit": """
with w as (select shard_id, concat_ws(',', case when coalesce(tokens <> list_sum(map_values(source_token_counts)), true) then 'tokens' end, case when coalesce(dtype <> 'uint32', true) then 'dtype' end,
 case when coalesce(byte_order <> 'little', true) then 'byte_order' end, case when not coalesce(regexp_full_match(sha256, '[0-9a-f]{64}'), false) then 'sha256' end) as wrong from token_shards)
select shard_id, wrong, count(*) as rows from w group by 1, 2""",
    "shard_lookup": _SHARDS
    + """, s as (select shard_id, cast(sum(tokens) as bigint) as tokens from c group by 1),
a as (select shard_id, tokens, cast(coalesce(sum(tokens) over (order by shard_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from s)
select x.position, shard_id, x.position - start as place from range(0, (select max(start + tokens) from a)) as x(position) join a on x.position >= start and x.position < start + tokens""",
    "secret_scan": f"select {_DOC} as source, count(*) filter ({' or '.join(f'contains(text, {quoted(s)})' for s in SECRETS)}) as documents, bool_or({' or '.join(f'contains(text, {quoted(s)})' for s in SECRETS)}) as found from documents group by 1",
    "failure_redaction": redacted("select record_id, 'job-0a1b2c3d at api.internal token=abc /private/x ' || coalesce(text, '') as x from raw_records"),
    "white_space": f"select {_DOC} as source, count(*) filter ({collapsed('text')} <> text) as changed, cast(sum(length({collapsed('text')})) as bigint) as chars from documents group by 1",
}
