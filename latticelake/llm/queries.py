"""The registered query of each training-data operator: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, disclosure, infill, lattice, lm, minhash, packing, quality, repeats, secrets, siteguide, variants



def _quality_sql() -> str:
    """The rules of quality.judge over whole tables. Bins that a text lacks add up to what is left of the reference."""
    words = ", ".join(f"('{w}', {i})" for i, w in enumerate(sorted(set(quality.COMMON_WORDS))))
    count = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    bins = {1: r"\x20", 2: r"\x09-\x0D", 3: "a-z", 4: "A-Z", 5: "0-9", 6: r"^\x00-\x7F", 7: ".,", 8: "!?", 9: "|", 10: "#*$%&<>"}
    rest = r"\x00-\x08\x0E-\x1F\x7F" + r"\-\"'()+/:;=@\[\\\]^_`{}~".replace("'", "''")
    classes = ", ".join(f"({k}, {count(c)})" for k, c in (bins | {11: rest}).items())
    return rf"""with d as materialized (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  k as materialized (select doc_id, lang, v.bin, v.c from d, lateral (values {classes}) v(bin, c) where v.c > 0),
  x as (select doc_id, lang, unnest(w) as word from d), wb as materialized (select doc_id, lang, coalesce(l.bin, -1) as bin, count(*) as c from x left join (values {words}) l(word, bin) on l.word = x.word group by 1, 2, 3),
  e as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as v from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from d where len(w) >= 8)),
  r as (select doc_id, count(distinct j) as n from (select doc_id, unnest(generate_series(i, i + 7)) as j from (select *, count(*) over (partition by doc_id, v) as n from e) q where n > 1) y group by 1),
  c as materialized (select d.doc_id, d.lang, cast(len(d.w) as bigint) as n_words, cast(coalesce((select sum(c) from k where k.doc_id = d.doc_id and bin >= 3), 0) as bigint) as word_chars, cast(coalesce((select sum(c) from k where k.doc_id = d.doc_id and bin in (9, 10)), 0) as bigint) as n_symbols,
    cast(len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words from d left join r using (doc_id)),
  f as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
  rw as (select lang, bin, sum(c) as c from wb where doc_id in (select doc_id from f where not base_failed) group by 1, 2), rk as (select lang, bin, sum(c) as c from k where doc_id in (select doc_id from f where not base_failed) group by 1, 2),
  known as (select lang, sum(c) as n from rw group by 1 having sum(c) >= {quality.LEAST_REFERENCE}),
  q as (select 'w' as h, lang, bin, c * 1.0 / sum(c) over (partition by lang) as q from rw union all select 'k', lang, bin, c * 1.0 / sum(c) over (partition by lang) from rk),
  p as (select 'w' as h, doc_id, lang, bin, c * 1.0 / sum(c) over (partition by doc_id) as p from wb union all select 'k', doc_id, lang, bin, c * 1.0 / sum(c) over (partition by doc_id) from k),
  s as (select p.h, p.doc_id, sum(p * log2(p / ((p + coalesce(q, 0)) / 2)) + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) + 1 - sum(coalesce(q, 0)) as s from p join known using (lang) left join q on q.h = p.h and q.lang = p.lang and q.bin = p.bin group by 1, 2),
  j as (select f.*, coalesce((select sqrt(greatest(0, least(1, s / 2))) from s where s.h = 'k' and s.doc_id = f.doc_id), 0.0) as class_js, coalesce((select sqrt(greatest(0, least(1, s / 2))) from s where s.h = 'w' and s.doc_id = f.doc_id), 0.0) as word_js from f)
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ((word_chars >= 200 and class_js > 0.30) or (n_words >= 50 and class_js + word_js > 0.50)) as kept, round(class_js, 6) as class_js, round(word_js, 6) as word_js from j"""


def _pii_sql() -> str:
    """The rules of disclosure.scan over whole tables: base spans, then terms that disclose an entity of the same text."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    split = lambda p: f"unnest(string_split_regex(t, '{p}')) as piece, unnest(regexp_extract_all(t, '{p}')) as match, unnest(range(len(string_split_regex(t, '{p}')))) as i"
    parts = " union all ".join(f"select own, '{k}' as kind, {j} as place, {split(p)} from u" for j, (k, p) in enumerate(patterns.items()))
    words = lambda x: f"regexp_extract_all(lower({x}), '{disclosure.WORD}')"
    form = lambda w: f"case when regexp_full_match({w}, '[0-9]+') then substr({w}, 1, 1) || repeat('#', length({w}) - 1) else substr({w}, 1, 1) || '*' end"
    long = lambda x: f"list_filter({x}, lambda w: length(w) >= 3)"
    terms = lambda x: f"list_distinct(list_concat({long(x)}, list_transform({long(x)}, lambda w: {form('w')})))"
    return rf"""with d as materialized (select doc_id, coalesce(text, '') as t, md5(coalesce(text, '')) as own from documents), u as materialized (select own, any_value(t) as t, count(*) as n from d group by own),
  m as (select *, coalesce(length(match), 0) as l, sum(length(piece) + coalesce(length(match), 0)) over (partition by own, kind order by i) as e, lead(piece) over (partition by own, kind order by i) as after, regexp_replace(match, '[^0-9]', '', 'g') as g from ({parts}) x),
  b as materialized (select own, kind, place, cast(e - l as bigint) as s, cast(e as bigint) as e, kind || ':' || case kind when 'email' then lower(match) when 'ip' then match else g end as entity,
    list_concat(list_reverse({words('piece')})[1:8], {words('after')}[1:8]) as near from m where match is not null and case kind when 'email' then true when 'ip' then len(list_filter(string_split(match, '.'), lambda x: length(ltrim(x, '0')) > 3 or cast(right(x, 3) as int) > 255)) = 0
    when 'phone' then length(g) between 9 and 15 else length(g) between 12 and 19 and list_sum(list_transform(range(length(g)), lambda j: case when j % 2 = 0 then cast(substr(g, length(g) - j, 1) as int) else (2 * cast(substr(g, length(g) - j, 1) as int)) // 10 + (2 * cast(substr(g, length(g) - j, 1) as int)) % 10 end)) % 10 = 0 end),
  near as materialized (select distinct own, entity, near as context, unnest({terms('near')}) as term from b),
  c as materialized (select entity, term, (select count(*) from documents) as total from near group by 1, 2 having count(distinct context) >= 3),
  both_ as (select entity, term, sum(n) as n_both from (select distinct entity, term, own from near) x join u using (own) group by 1, 2),
  said as (select term, count(*) as n_term from (select unnest({terms(words('t'))}) as term from d) x where term in (select term from c) group by 1),
  ent as (select entity, sum(n) as n_entity from (select distinct entity, own from b) x join u using (own) group by 1),
  told as materialized (select distinct entity, term from c join both_ using (entity, term) join said using (term) join ent using (entity)
    where n_entity < total and not regexp_matches(term, '[*#]$') and log2(n_both * cast(total as double) / (n_entity * n_term)) >= 0.95 * log2(total / n_entity)),
  held as materialized (select distinct own, entity from b where entity in (select entity from told)),
  tok as (select own, match, coalesce(length(match), 0) as l, sum(length(piece) + coalesce(length(match), 0)) over (partition by own order by i) as e from (select own, {split(disclosure.WORD)} from u where own in (select own from held)) x),
  hit as (select distinct tok.own, cast(e - l as bigint) as s, cast(e as bigint) as e from tok join told on told.term = lower(match) join held on held.own = tok.own and held.entity = told.entity where length(match) >= 3),
  free as materialized (select * from hit where not exists (select 1 from b where b.own = hit.own and b.s < hit.e and hit.s < b.e)),
  z as (select own, string_agg(kind || ':' || s || ':' || e, ',' order by s, place, e) filter (where place < 4) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, place, e) as spans, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip,
    count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone, count(*) filter (where kind = 'term') as n_term from (select own, kind, place, s, e from b union all select own, 'term', 4, s, e from free) x group by 1)
  select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_term, 0) as n_term from d left join z using (own)"""


#: SQL twins, where DuckDB can express the whole result on whole tables.
ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as materialized (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from w),
  g as materialized (select min(doc_id) as doc_id, s, len(s) as n from (select doc_id, list_sort(s) as s from s) x where len(s) > 0 group by s),
  x as materialized (select doc_id, n, unnest(s) as v from g), k as (select v from x group by 1 having count(*) > 1),
  p as materialized (select a.doc_id as a, b.doc_id as b from x a join x b on a.v = b.v and a.doc_id <> b.doc_id where a.v in (select v from k) and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 group by 1, 2, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  r(a, b) as (select a, b from p union select r.a, p.b from r join p on p.a = r.b), m as (select a, min(b) as m from r group by 1),
  c as (select list_sort(s.s) as s, coalesce(least(m.m, g.doc_id), g.doc_id) as c from g join s using (doc_id) left join m on m.a = g.doc_id)
  select d.doc_id, cast(len(d.s) as bigint) as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept from s d left join c on c.s = list_sort(d.s)""",
    "op3_embedding_near_dedup": r"""with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
  u as materialized (select vec_id, label, e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(e, e) > 0),
  p as materialized (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
  r(a, b) as (select a, b from p union select r.a, p.b from r join p on p.a = r.b),
  n as (select a, count(*) as n from p group by 1), m as (select a, min(b) as m from r group by 1)
  select vec_id, coalesce(n.n, 0) as n_links, coalesce(least(m.m, vec_id), vec_id) as component_id, coalesce(least(m.m, vec_id), vec_id) = vec_id as kept from embeddings left join n on n.a = vec_id left join m on m.a = vec_id""",
    "op8_suffix_array_dedup": r"""with h as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
  w as materialized (select doc_id, i, hash(substr(piece, 2 * (i - lo) + 1, 200)) as v from (select doc_id, lo, piece, unnest(generate_series(lo, least(lo + 399, n - 100))) as i from (select doc_id, lo, n, substr(h, 2 * lo + 1, 1000) as piece from (select doc_id, h, len(h) // 2 as n, unnest(generate_series(0, len(h) // 2 - 100, 400)) as lo from h where len(h) >= 200)))),
  f as (select *, row_number() over (partition by v order by doc_id, i) as k from w),
  g as (select doc_id, i, i - row_number() over (partition by doc_id order by i) as z, lag(i) over (partition by doc_id order by i) as before from f where k > 1),
  t as (select doc_id, i, sum(case when before is null or i - before > 100 then 1 else 0 end) over (partition by doc_id order by i) as run from g),
  s as (select doc_id, run, min(i) as a, max(i) + 100 as b from t group by 1, 2), o as (select doc_id, count(*) as n, sum(b - a) as gone, list({'a': a, 'b': b} order by a) as s from s group by 1)
  select h.doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(n, 0) as n_spans,
  sha256(unhex(case when s is null then h else substr(h, 1, 2 * s[1].a) || array_to_string(list_transform(generate_series(1, len(s)), lambda j: substr(h, 2 * s[j].b + 1, 2 * (coalesce(s[j + 1].a, len(h) // 2) - s[j].b))), '') end)) as kept_sha256 from h left join o using (doc_id)""",
    "op9_chat_formatting": r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, role, text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]') x)
  select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256, cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 20) as bigint) as formatted_chars from t group by 1""",
    "op7_quality_rules": _quality_sql(),
    "op13_spelling_variants": r"""with recursive tab as materialized (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
  r as materialized (select coalesce(cast(doc_id as varchar), '') || ':' || w as s, w, count(*) as c from (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) as w from documents) x group by all),
  k as (select w, c, xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(s))), lambda i: cast('0x' || substr(hex(encode(s)), 2 * i + 1, 2) as bigint))), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) as h from r, tab),
  v as materialized (select word, cast(sum(c) as bigint) as n from (select case when h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, c from k) y where length(word) >= 7 group by 1 having sum(c) >= 2),
  d as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as short from v, lateral (select unnest(range(length(word))) as i) z),
  p as materialized (select distinct a.word as a, b.word as b, b.n from d a join d b on a.short = b.short and a.i = b.i and a.word <> b.word union select d.word, v.word, v.n from d join v on v.word = d.short union select v.word, d.word, d.n from d join v on v.word = d.short),
  c as (select a, count(*) as n_near from p group by 1), g as (select p.a, p.b, p.n from p join v on v.word = p.a where p.n >= 10 * v.n qualify row_number() over (partition by p.a order by p.n desc, p.b) = 1),
  top as (select p.a, max(n) as m from p group by 1), f as materialized (select g.* from g join top on top.a = g.a and g.n = top.m),
  s(word, here) as (select word, word from v union all select s.word, f.b from s join f on f.a = s.here), e as (select word, here from s where here not in (select a from f))
  select v.word, f.b as form, e.here as root, v.n, coalesce(c.n_near, 0) as n_near, f.n as form_n from v join e using (word) left join c on c.a = v.word left join f on f.a = v.word""",
    "op11_pii": _pii_sql(),
    "op12_fill_in_middle": r"""with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
  e as (select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as y, cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d),
  f as (select *, least(x, y) as a, greatest(x, y) as b, case when n = 0 or h3 % 100 >= 90 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from e),
  g as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from f)
  select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from g""",
}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file as installed on the driver and every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    place = F.array(*(F.lit(k) for k in secrets.KINDS))
    order = lambda x: F.struct(x["start"], F.array_position(place, x["kind"]), x["end"], x["kind"].alias("kind"))
    text = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = siteguide.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept", F.round("class_js", 6).alias("class_js"), F.round("word_js", 6).alias("word_js"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_trees(chat.from_turns(rows.unionByName(own))))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = disclosure.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(disclosure.ordered(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat("base", F.transform("added", lambda x: F.struct(x["kind"], x["start"], x["end"])))
    return seen.select("doc_id", *(count(k) for k in disclosure.PATTERNS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(both).alias("spans"), F.size("added").cast("long").alias("n_term"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_embedding_near_dedup, op4_secret_scans, op5_lm_scoring, op6_html_extraction, op7_quality_rules, op8_suffix_array_dedup, op9_chat_formatting, op10_byte_bpe, op11_pii, op12_fill_in_middle, op13_spelling_variants)}
