"""One query for each operator over its whole table, and the DuckDB statement where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelbook.llm import chat, decontaminate, extract, hamming_topk, language, lsh_search, manifest, packing, pii, runs, secret_scan, simhash, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages).select("page_id", "url", "text", "n_chars")


#: A conversation whose texts hold the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    return chat.digest(chat.examples(rows.unionByName(own)))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    learned = language.profiles(documents.where("not held_out"))
    return language.identify(documents.select("doc_id", "held_out", "text"), learned).select("doc_id", "held_out", "lang_pred", "score")


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming_topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0), k=10)


#: The key of the registered queries; a real run brings its own.
KEY = "registered-query-key"


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.count_tokens(documents, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens")


def op11_lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return lsh_search.search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def _repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by checksum has a stretch of its words repeated to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = documents.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    planted = planted.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    # slices and repeats of whole arrays: no step a word
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("densest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * densest.length div densest.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    text, fields = F.col("text"), [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    untouched = manifest.leaf_digest([*fields, text])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf_digest([*fields, lower])).otherwise(untouched)
    listed = manifest.manifest(documents.select("doc_id", "source", untouched.alias("leaf"), tampered.alias("tampered")))
    told = listed.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"),
                         manifest.folded(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


REGISTRY = {f.__name__: f for f in (op1_decontaminate, op2_simhash, op3_extract, op4_chat, op5_packing, op6_language, op7_hamming_topk, op8_pii, op9_secret_scan, op10_token_count, op11_lsh_search, op12_runs, op13_manifest)}

ORACLE_SQL = {
    "op1_decontaminate": r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
items as (
  select coalesce(cast(item_id as varchar),'') item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
windows as (
  select distinct item, least(len(w),10) n, array_to_string(w[i:i+9],' ') phrase
  from (select item, w, unnest(range(1, greatest(len(w)-9,1)+1)) i from items where len(w)>0)),
sizes as (select distinct n from windows),
grams as (
  select doc_id, i, n, array_to_string(w[i:i+n-1],' ') phrase
  from (select doc_id, w, n, unnest(range(1, len(w)-n+2)) i from words, sizes where len(w)>=n)),
hits as (select doc_id, i, g.n, item from grams g join windows v on v.n=g.n and v.phrase=g.phrase),
hit_words as (select doc_id, count(distinct k) n_hit from (select doc_id, unnest(range(i, i+n)) k from hits) group by 1),
hit_items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, item from hits) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit,0) n_hit, coalesce(n_items,0) n_items,
  sha256(coalesce(names,'')) items_sha256, coalesce(n_hit,0)>0 contaminated
from words left join hit_words using(doc_id) left join hit_items using(doc_id)""",
    "op7_hamming_topk": """
with c as (
  select vec_id, cast(array_to_string(list_transform(embedding, lambda x: case when x>0 then '1' else '0' end), '') as bit) code
  from embeddings where embedding is not null),
d as (
  select q.vec_id query_id, c.vec_id neighbor_id, cast(bit_count(xor(q.code, c.code)) as bigint) distance
  from c q, c where q.vec_id % 20 = 0)
select *, row_number() over (partition by query_id order by distance, neighbor_id) rank from d
qualify row_number() over (partition by query_id order by distance, neighbor_id) <= 10""",
    "op4_chat": r"""
with c as (
  select conv_id, turn, coalesce(role,'') r, coalesce(text,'') x from conversations
  union all select -1, k, case when k=0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) z(k)),
e as (
  select *, 24 + length(replace(replace(replace(r,'\','\\'),'<|','<\|'),chr(10),'\n')) + length(replace(replace(x,'\','\\'),'<|','<\|')) size,
    row_number() over (partition by conv_id order by turn, r, x) p, count(*) over (partition by conv_id) n from c),
f as (select *, sum(size) over (partition by conv_id order by p) upto from e)
select conv_id, count(*) n_turns, sha256(string_agg(r||chr(10)||x||chr(10),'' order by p)) turns_sha256,
  cast(coalesce(sum(length(x)) filter (r='assistant'),0) as bigint) loss_chars,
  sha256(coalesce(string_agg(x,'' order by p) filter (r='assistant'),'')) loss_sha256,
  cast(sum(upto) filter (r='assistant' or p=n) as bigint) formatted_chars
from f group by conv_id""",
    "op13_manifest": """
with recursive fields as (
  select doc_id, source, text, concat_ws('', coalesce(octet_length(encode(doc_id::varchar))||':'||doc_id, '-'),
    coalesce(octet_length(encode(source))||':'||source, '-'), coalesce(octet_length(encode(lang))||':'||lang, '-'),
    coalesce(octet_length(encode(n_chars::varchar))||':'||n_chars, '-')) head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low,
    xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) crc from documents),
digests as (
  select doc_id, case when source is null then '' else 's'||source end tree, sha256(head||coalesce(octet_length(encode(text))||':'||text, '-')) leaf,
    sha256(head||coalesce(octet_length(encode(case when crc % 5 = 0 then low else text end))||':'||case when crc % 5 = 0 then low else text end, '-')) changed from fields),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by tree) n from digests),
up as (
  select tree, 0 lvl, pos, n, leaf d from leaves
  union all
  select tree, lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(d, '' order by pos)) from up where n > 1 group by tree, lvl, pos // 16),
tops as (select tree, d, row_number() over (order by tree) - 1 pos, count(*) over () n from up where n = 1),
crown as (
  select 0 lvl, pos, n, d from tops
  union all
  select lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(d, '' order by pos)) from crown where n > 1 group by lvl, pos // 16),
runs as (select tree, lvl, pos // 16 run, list(d order by pos) ds from up where n > 1 group by all),
crown_runs as (select lvl, pos // 16 run, list(d order by pos) ds from crown where n > 1 group by all),
low_steps as (
  select l.tree, l.pos, r.lvl, array_to_string(ds[1:(l.pos >> (4*r.lvl)) & 15], '')||'|'||array_to_string(ds[((l.pos >> (4*r.lvl)) & 15) + 2:], '') step
  from leaves l join runs r on r.tree = l.tree and r.run = l.pos >> (4*r.lvl + 4)),
high_steps as (
  select t.tree, r.lvl, array_to_string(ds[1:(t.pos >> (4*r.lvl)) & 15], '')||'|'||array_to_string(ds[((t.pos >> (4*r.lvl)) & 15) + 2:], '') step
  from tops t join crown_runs r on r.run = t.pos >> (4*r.lvl + 4)),
lows as (select tree, pos, list(step order by lvl) steps from low_steps group by all),
highs as (select tree, list(step order by lvl) steps from high_steps group by all),
proofs as (
  select l.doc_id, l.leaf, l.changed, t.d subroot, (select d from crown where n = 1) root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) steps
  from leaves l join tops t on t.tree = l.tree left join lows a on a.tree = l.tree and a.pos = l.pos left join highs b on b.tree = l.tree),
told as (
  select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) proof_sha256,
    list_reduce(list_concat([changed], steps), lambda d, s: sha256(split_part(s, '|', 1)||d||split_part(s, '|', 2))) folded_root from proofs)
select *, folded_root = root verified from told""",
}
