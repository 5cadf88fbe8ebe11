"""Registered queries of the training-data operators (name -> builder) and
their DuckDB SQL twins.  Each query is a thin wrapper: it reads the whole
table, calls its operator with production parameters and derives the digest
columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import chat, exact_dedup, fingerprints, hard_negatives, line_dedup, mixing, packing, prefix_trie, quality, rules, simhash, token_counts, token_file
from quarry.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return add


# Pieces of SQL used by several twins.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (installed on every machine)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_cws_fingerprints")
def op1_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(load(spark, sf_dir, "documents"))


@query("op2_token_file")
def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), special=True)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op4_mixing", sql=f"""
with d as (select doc_id, source, len({_WORDS})::bigint as size, md5('{mixing.SEED}:' || coalesce(doc_id::varchar, '')) as key from documents),
s as (select source, sum(size)::double as ss, row_number() over (order by source nulls last) - 1 as k from d group by source),
t as (select *, {list(mixing.WEIGHTS)}[k % {len(mixing.WEIGHTS)} + 1] as w, {mixing.MAX_EPOCHS} * ss as cap,
             {mixing.SHARE} * (select sum(size)::double from d) as budget from s),
o as (select *, cap / w as r, coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) as below,
             sum(w) over (order by cap / w, k rows between current row and unbounded following) as free from t),
l as (select arg_min((budget - below) / free, row(r, k)) as level from o where (budget - below) / free * w <= cap),
g as (select source, ss, case when level is null then cap else least(cap, level * w) end as target from t, l),
p as (select *, case when ss > 0 then floor(target / ss) else 0 end as whole from g),
c as (select d.*, p.ss, p.target, p.whole, p.target - p.whole * p.ss as rest,
             sum(size) over (partition by d.source order by key range between unbounded preceding and current row) as upto,
             sum(size) over (partition by d.source, key) as own
      from d join p on d.source is not distinct from p.source)
select doc_id, size, ss::bigint as source_size, target,
       (size * (whole + case when rest > 0 and upto - own / 2.0 <= rest then 1 else 0 end))::bigint as taken
from c
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("reps")).alias("taken"))


@query("op5_chat", sql=rf"""
with t as (select distinct conv_id, turn, coalesce(role, '{chat.UNKNOWN}') as speaker, coalesce(text, '') as text from conversations),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker, text) - 1 as rank from t),
s as (select distinct conv_id, speaker as perspective from t where speaker <> '{chat.SYSTEM}'),
r as (select p.conv_id, s.perspective, rank // {chat.CHUNK} as chunk, rank, speaker = perspective as mine,
        '{chat.START}' || case when speaker = '{chat.SYSTEM}' then 'system' when speaker = perspective then 'assistant'
            else 'user name=' || regexp_replace(speaker, '<\|(im_start|im_end)\|>', '<|  |>', 'g') end || chr(10) as head,
        regexp_replace(text, '<\|(im_start|im_end)\|>', '<|  |>', 'g') || '{chat.END}' as body
      from p join s on p.conv_id is not distinct from s.conv_id),
o as (select *, sum(length(head) + length(body) + 1) over (partition by conv_id, perspective, chunk order by rank) - length(body) - 1 as a from r)
select conv_id, perspective, chunk, count(*) as n_turns, string_agg(head || body || chr(10), '' order by rank) as text,
       string_agg(case when mine then a || '-' || (a + length(body)) end, ' ' order by rank) as mask
from o group by 1, 2, 3
""")
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render_perspectives(load(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.array_join(m, "-"))
    return out.withColumn("mask", F.when(F.size(spans) > 0, F.array_join(spans, " ")))


@query("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), special=True)


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op8_line_dedup", sql=f"""
with d as (select row_number() over () as rid, doc_id, source, string_split(text, chr(10)) as ls from documents),
l as (select rid, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (select *, nullif(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '') as bare from l),
h as (select source, count(*) as host_pages from d group by source),
f as (select source, bare, count(distinct rid) as pages from k where bare is not null group by 1, 2),
bad as (select f.source, f.bare from f join h on f.source is not distinct from h.source
        where pages >= 2 and (pages / host_pages + 0.5 / host_pages::double - sqrt(pages / host_pages * (1 - pages / host_pages) / host_pages
          + 0.25 / (host_pages::double * host_pages))) / (1 + 1.0 / host_pages::double) > {line_dedup.MAX_RATIO}),
m as (select k.rid, k.line, k.pos, b.bare is not null as dropped
      from k left join bad b on k.source is not distinct from b.source and k.bare = b.bare),
o as (select rid, coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '') as text,
             sum(dropped::int)::bigint as n_dropped from m group by rid)
select doc_id, source, o.text, coalesce(n_dropped, 0) as n_dropped from d left join o using (rid)
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, host="source")
    return out.select("row.doc_id", "row.source", F.col("kept").alias("text"), F.col("dropped").alias("n_dropped"))


_LEDGER_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, {_WORDS} as w from documents),
ln as (select rid, unnest(string_split(text, chr(10))) as line from d),
nl as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
       from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
p as (select rid, unnest(generate_series(1, len(w) - 2)) as i, w from d where len(w) >= 3),
tri as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from p),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from tri) where n > 1),
cov as (select rid, count(*) as n_repeat_words from
        (select distinct rid, unnest([i, i + 1, i + 2]) as j from rep) group by rid),
m as (select doc_id, len(w) as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
        length(text) - length(translate(text, '{rules.SYMBOLS}', '')) as n_symbols,
        coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
        coalesce(n_lines, 0) as n_lines,
        length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) as n_letters,
        length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_upper
      from d left join nl using (rid) left join cov using (rid)),
v as (select *, {" + ".join(f"(case when {r.fails} then {1 << i} else 0 end)" for i, r in enumerate(rules.RULES))} as fail_bits from m)
"""


@query("op9_rule_ledger", sql=_LEDGER_SQL + f"""
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       (fail_bits & {rules.mask_of(rules.POLICIES["base"])}) <> 0 as base_failed,
       (fail_bits & {rules.mask_of(rules.POLICIES[rules.PRODUCTION])}) = 0 as kept,
       (fail_bits & {rules.mask_of(rules.POLICIES["v1"])}) = 0 as kept_v1
from v
""")
def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(load(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "fail_bits", (~rules.passes("base")).alias("base_failed"), rules.passes(rules.PRODUCTION).alias("kept"),
        rules.passes("v1").alias("kept_v1"))


def _ablation_sql() -> str:
    one = """select '{policy}' as policy, '{rule}' as rule, sum((fail_bits & {bit} <> 0)::int)::bigint as n_failed,
       sum((fail_bits & {mask} = {bit})::int)::bigint as n_only_this, count(*) as n_docs, bit_or(fail_bits)::bigint as bits_seen from v having count(*) > 0"""
    bits = {r.name: 1 << i for i, r in enumerate(rules.RULES)}
    return " union all ".join(one.format(policy=p, rule=r, bit=bits[r], mask=rules.mask_of(names)) for p, names in rules.POLICIES.items() for r in names)


@query("rule_ablations", sql=_LEDGER_SQL + _ablation_sql())
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.all_ablations(rules.ledger(load(spark, sf_dir, "documents")))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path(token_counts.VOCABULARY))


_CRC_STEP = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"


@query("op11_prefix_trie", sql=f"""
with recursive t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
      from conversations where conv_id is not null),
c as (select distinct conv_id, conv_id - conv_id % {prefix_trie.GROUP} as base, conv_id::varchar as s from t),
crc as (select conv_id, s, 4294967295::bigint as c, 0 as bit from c
        union all select conv_id, s, {_CRC_STEP.replace("c %", "d %").replace("c >>", "d >>").replace("else c", "else d")}, bit + 1
        from (select *, case when bit % 8 = 0 then xor(c, ascii(substr(s, bit // 8 + 1, 1))::bigint) else c end as d from crc where bit < 8 * length(s))),
h as (select conv_id, base, xor(arg_max(crc.c, bit), 4294967295) % {prefix_trie.BORROWED} as h from c join crc using (conv_id) group by all),
lent as (select h.conv_id, pos, role, text from h join t on t.conv_id = base and pos <= h),
m as (select conv_id, count(*) as m from lent group by 1),
r as (select * from lent union all
      select t.conv_id, pos - h + coalesce(m, 0), role, text from t join h using (conv_id) left join m using (conv_id) where pos > h),
q as (select conv_id, coalesce(list({{'role': role, 'text': text}} order by pos) filter (where pos is not null), []) as seq
      from c left join r using (conv_id) group by 1),
p as (select conv_id, seq, unnest(range(len(seq) + 1)) as depth from q),
n as (select seq[:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
        coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(seq) = depth), '') as ends from p group by 1, 2),
k as (select seq[:depth - 1] as node, count(*) as n_children from (select distinct seq[:depth] as seq, depth from p where depth > 0) group by 1),
f as (select n.*, coalesce(n_children, 0) as n_children, case when depth > 0 then (n_convs - 1) * length(node[depth].text) else 0 end as saved
      from n left join k using (node)),
u as (select f.node[:a.d] as node, sum(saved)::bigint as saved_tokens, sum((n_children = 0)::int)::bigint as n_leaves
      from f, lateral (select unnest(range(f.depth + 1)) as d) a group by 1)
select f.conv_id, f.depth, parent.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves, u.saved_tokens, sha256(f.ends) as ends_sha256
from f join u using (node) left join f parent on f.depth > 0 and parent.node = f.node[:f.depth - 1]
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns_in_order(load(spark, sf_dir, "conversations"))
    nodes, ends = prefix_trie.prefix_trie(prefix_trie.rebuild(turns))
    digests = prefix_trie.end_digests(ends)
    full = nodes.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_HN = hard_negatives


@query("op12_hard_negatives", sql=f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor({_HN.SCALE} * x::double)) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as al, b.vec_id as id, b.label, list_dot_product(a.v, b.v)::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, al, id as positive_id, score as positive_score from s where label = al
      qualify row_number() over (partition by anchor_id order by score desc, id) <= {_HN.POSITIVES}),
n as (select p.anchor_id, positive_id, id as negative_id, positive_score, score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::integer as rank
      from p join s on p.anchor_id = s.anchor_id and s.label <> p.al
       and {_HN.LOW} * positive_score <= 100 * score and 100 * score <= {_HN.HIGH} * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= {_HN.NEGATIVES}
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


@query("op13_exact_dedup", sql=r"""
with d as (select row_number() over () as rid, doc_id, length(coalesce(text, '')) as size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
k as (select *, first_value(doc_id) over w as keep_id, first_value(rid) over w as keep_rid, count(*) over (partition by text_sha256) as group_size
      from d window w as (partition by text_sha256 order by size desc, doc_id nulls last, rid))
select doc_id, keep_id, group_size, rid = keep_rid as kept, text_sha256 from k
""")
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = exact_dedup.mark_copies(load(spark, sf_dir, "documents"), columns=["doc_id"])
    return marked.select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")
