"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from holdspan.llm import (
    fingerprint,
    jaccard,
    linededup,
    merkle,
    mixing,
    packing,
    quality,
    spelling,
    tokencount,
    tokenout,
    topk,
    toxicity,
    urlfilter,
)
from holdspan.llm.common import sql_ascii_lower, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op8_token_counts")
def op8(spark, sf_dir):
    """Tokens of every document by the 50k byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), path, limit=512)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op9_url_filters",
    """
with rules(rh, rp, verdict) as (values
    ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
    ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut as (
    select row_number() over () as n, page_id,
           case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
    from pages),
split as (
    select n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
    from cut),
fit as (
    select n, rh || rp as rule, verdict,
           row_number() over (partition by n order by length(rh || rp) desc) as k
    from split join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from split left join (select * from fit where k = 1) using (n)
""",
)
def op9(spark, sf_dir):
    """The url rules over all pages."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op3_quality_rules",
    r"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as worded,
             len(string_split(text, chr(10))) as n_lines
      from t),
one as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from w),
three as (select r, i, word, lead(word, 1) over s as second, lead(word, 2) over s as third
          from one window s as (partition by r order by i)),
again as (select r, i, count(*) over (partition by r, word, second, third) as n from three where third is not null),
places as (select distinct r, i + k as i from again, (values (0), (1), (2)) as o(k) where n > 1),
covered as (select r, count(*) as n from places group by r),
measures as (
    select doc_id, cast(len(words) as bigint) as n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
           length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
           cast(len(worded) - len(list_distinct(worded)) as bigint) as n_dup_lines,
           coalesce(n, 0) as n_repeat_words,
           cast(n_lines as bigint) as n_lines,
           length(text) - length(replace(text, '!', '')) as n_marks,
           cast(len(list_filter(words, lambda x: list_contains(string_split(
               'the of and to in is that it for was on are as with be at by this have from or an not '
               || 'le la les de des du et en un une est que qui dans pour sur pas par au avec '
               || 'el los las y una es del por con para se lo como su '
               || 'der die das und ist nicht ein eine zu von mit den dem im auf für sich', ' '), lower(x)))) as bigint)
               as n_stop_words
    from w left join covered using (r)),
base as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from measures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_stop_words, base_failed,
       not base_failed and word_chars * 100 between n_words * 250 and n_words * 1500
       and n_symbols * 100 <= n_words * 15 and n_marks * 100 <= n_words * 50
       and n_dup_lines * 100 <= n_lines * 40 and n_stop_words * 100 >= n_words as kept
from base
""",
)
def op3(spark, sf_dir):
    """Measures, base rules and verdict of every document."""
    return quality.apply_rules(quality.measure(table(spark, sf_dir, "documents")))


@query("op10_toxicity")
def op10(spark, sf_dir):
    """Toxicity of every document, learned from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_texts(docs, toxicity.train(docs, labels))


@query("op2_token_output")
def op2(spark, sf_dir):
    """Packed id matrices of all documents."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenout.token_matrices(table(spark, sf_dir, "documents"), path, capacity=2048)


@query("op5_packing")
def op5(spark, sf_dir):
    """Pieces of all documents in sequences of 2048 ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, capacity=2048, end_id=1)


# Parts of a mixture in which twenty sources have one to four shares each.
MIX_WEIGHTS = {f"src{k}": 1 + k % 4 for k in range(20)}


@query(
    "op7_mixing_sources",
    """
with recursive names as (
    select ['rest', 'src0', 'src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18',
            'src19', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'] as name,
           [1, 1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4, 3, 4, 1, 2, 3, 4, 1, 2] as w),
edf(slot, done, best) as (
    select -1, list_transform(w, lambda x: 0), 0::bigint from names
    union all
    select slot + 1, list_transform(done, lambda k, i: case when i = b then k + 1 else k end), b
    from (select slot, done,
                 list_sort(list_filter(
                     list_transform(done, lambda k, i: {'due': cast(ceil((k + 1) * 51 / w[i]) as int), 'i': i,
                                                        'ready': floor(k * 51 / w[i]), 'k': k}),
                     lambda x: x.ready <= slot + 1 and x.k < w[x.i]))[1].i as b
          from edf, names where slot < 50) q),
plan as (
    select name[best] as mix, w[best] as w, slot,
           row_number() over (partition by best order by slot) - 1 as turn
    from edf, names where slot >= 0),
numbered as (
    select doc_id, source, coalesce(n.mix, 'rest') as mix,
           row_number() over (partition by coalesce(n.mix, 'rest') order by md5(cast(doc_id as varchar))) - 1 as nth
    from documents left join (select distinct mix from plan) n on n.mix = source)
select doc_id, source, cast(nth // 64 as bigint) as block, cast(nth % 64 as bigint) as inside_block,
       cast(nth // 64 // w * 51 + slot as bigint) as slot,
       cast(nth // 64 // w * 51 + floor(turn * 51 / w) as bigint) as release,
       cast(nth // 64 // w * 51 + ceil((turn + 1) * 51 / w) as bigint) as deadline
from numbered join plan on numbered.mix = plan.mix and nth // 64 % w = turn
""",
)
def op7(spark, sf_dir):
    """Slot of every document in the mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = mixing.schedule(docs, MIX_WEIGHTS)
    new = {"_block": "block", "_inside_block": "inside_block", "_slot": "slot", "_release": "release", "_deadline": "deadline"}
    return mixed.withColumnsRenamed(new).drop("_mix")


@query("op4_jaccard_join")
def op4(spark, sf_dir):
    """Classes of documents whose 4-word n-grams are similar by 0.85 or more."""
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), width=4, percent=85)


@query(
    "op6_line_dedup",
    r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (select r, doc_id, unnest(string_split(text, chr(10))) as line,
                 generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as last_doc from keyed where length(key) >= 40
           group by key having count(distinct doc_id) >= 5),
judged as (select r, keyed.doc_id, i, line, coalesce(keyed.doc_id < last_doc, false) as gone
           from keyed left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by r, doc_id
""",
)
def op6(spark, sf_dir):
    """What line dedup leaves of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = {"_n_lines": "n_lines", "_n_dropped": "n_dropped", "_kept_sha256": "kept_sha256"}
    return linededup.dedup_lines(docs).withColumnsRenamed(new).drop("text", "_kept")


@query(
    "op1_top_k",
    """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank, vec_id, cast(score as bigint) as score from ranked where rank <= 5
""",
)
def op1(spark, sf_dir):
    """The five best vectors for every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


# The CRC-32 of a text, bit by bit: each byte is met, then shifted out in eight steps.
CRC = """xor(list_reduce(
    flatten(list_transform(generate_series(1, strlen({0})),
                           lambda i: [cast('0x' || substr(hex({0}), 2 * i - 1, 2) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end,
    4294967295::bigint), 4294967295)"""


def _merkle_levels(name: str, levels: int) -> str:
    """From ``<name>0`` (g, pos, n, h) to the tops, with what stands beside each node."""
    out = []
    for k in range(levels):
        run = "partition by g, pos // 16 order by pos rows between"
        out.append(f"""{name}_beside{k} as (
    select g, pos, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as l,
           coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as r
    from {name}{k} where n > 1)""")
        out.append(f"""{name}{k + 1} as (
    select g, pos // 16 as pos, cast(ceil(n / 16.0) as bigint) as n, sha256(string_agg(h, '' order by pos)) as h
    from {name}{k} where n > 1 group by g, pos // 16, n)""")
    tops = " union all ".join(f"select g, h from {name}{k} where n = 1" for k in range(levels + 1))
    return ",\n".join(out) + f",\n{name}_tops as ({tops})"


def _merkle_climb(name: str, start: str, levels: int) -> str:
    """Folds ``<start>`` (g, pos, fold, beside, ...) up the levels of ``name``."""
    out = []
    for k in range(levels):
        out.append(f"""{start}{k + 1} as (
    select d.* replace (case when b.l is null then fold else sha256(b.l || fold || b.r) end as fold,
                        beside || coalesce(b.l || b.r, '') as beside, d.pos // 16 as pos)
    from {start}{k} d left join {name}_beside{k} b on d.g is not distinct from b.g and d.pos = b.pos)""")
    return ",\n".join(out)


STATED = "coalesce(strlen(cast({0} as varchar)) || ':' || {0}, '-')"
LEAF = "sha256(" + " || ".join(STATED.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_merkle_manifest",
    f"""
with leaves as (
    select doc_id, source as g, {LEAF.format("text")} as h,
           case when {CRC.format("cast(doc_id as varchar)")} % 5 = 0 then {LEAF.format(LOWERED)} end as altered
    from documents),
leaf0 as (
    select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by g) as n
    from leaves),
{_merkle_levels("leaf", 6)},
source0 as (
    select 0 as g, g as source, row_number() over (order by g nulls first) - 1 as pos, count(*) over () as n, h from leaf_tops),
{_merkle_levels("source", 3)},
doc0 as (select doc_id, h as leaf, g, pos, coalesce(altered, h) as fold, '' as beside from leaf0),
{_merkle_climb("leaf", "doc", 6)},
top0 as (
    select d.doc_id, d.leaf, s.h as subroot, 0 as g, s.pos, d.fold, d.beside
    from doc6 d join source0 s on d.g is not distinct from s.source),
{_merkle_climb("source", "top", 3)}
select doc_id, leaf, subroot, t.h as root, sha256(beside) as proof_sha256, fold as folded_root, fold = t.h as verified
from top3, source_tops t
""",
)
def op11(spark, sf_dir):
    """Proof of every document in the manifest, with the text of a fifth of them altered."""
    docs = table(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, sql_ascii_lower(F.col("text")))
    found = merkle.proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", {"text": altered})
    return found.withColumnRenamed("siblings_sha256", "proof_sha256")


@query("op12_document_fingerprints")
def op12(spark, sf_dir):
    """Fingerprints of every document and of its edited text."""
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


@query(
    "op13_spelling_variants",
    f"""
with recursive runs as (
    select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as raw from documents),
lowered as (
    select doc_id, {LOWERED.replace("text", "raw")} as run, count(*) as times from runs where length(raw) >= 7 group by all),
hashed as (
    select run, times, {CRC.format("named")} as crc from (select *, cast(doc_id as varchar) || ':' || run as named from lowered)),
altered as (
    select case when crc % 31 = 0 then left(run, cast(crc % length(run) as int)) || substr(run, cast(crc % length(run) + 2 as int))
                else run end as word, times from hashed),
words as (
    select word, cast(sum(times) as bigint) as n from altered where length(word) >= 7 group by word having sum(times) >= 2),
shorter as (
    select word, n, length(word) as size, i, left(word, i - 1) || substr(word, i + 1) as rest
    from (select word, n, unnest(generate_series(1, length(word))) as i from words)),
pairs as (
    select distinct a.word, a.n, b.word as other, b.n as m
    from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.word <> b.word and a.size = b.size
    union
    select distinct a.word, a.n, b.word, b.n from shorter a join words b on a.rest = b.word
    union
    select distinct b.word, b.n, a.word, a.n from shorter a join words b on a.rest = b.word),
ranked as (
    select word, n, other, m, count(*) over (partition by word) as n_near,
           row_number() over (partition by word order by m desc, other) as k from pairs),
found as (
    select w.word, w.n, coalesce(n_near, 0) as n_near,
           case when m >= 10 * w.n then other end as form, case when m >= 10 * w.n then m end as form_n
    from words w left join ranked r on r.word = w.word and k = 1),
steps as (
    select word, word as root from found
    union all
    select s.word, f.form from steps s join found f on f.word = s.root where f.form is not null),
ends as (
    select s.word, s.root from steps s join found f on f.word = s.root where f.form is null)
select word, form, root, n, n_near, form_n from found join ends using (word)
""",
)
def op13(spark, sf_dir):
    """Near words, form and root of every word of the documents."""
    return spelling.variant_groups(table(spark, sf_dir, "documents"))
