"""The registered queries of the corpus operators, over whole tables, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, exact_dedup, language, lm, minhash, mixing, packing, quality, resample, secrets, sharding, toxicity, trie

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files have this one."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, rule votes and the posterior verdict of every document."""
    found = quality.assess(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "quality")


#: Shards of op2_sharding.
SHARDS = [f"shard-{k:02d}" for k in range(64)]


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document among 64, by its id."""
    return sharding.place(read(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


#: The table itself is filled in turns, which SQL doesn't express; the oracle places keys by the same table.
ORACLES["op2_sharding"] = f"""
with t as (select unnest(range({sharding.SLOTS}))::int as slot, unnest([{",".join(map(str, sharding.lookup_table(SHARDS)))}]) as k)
select doc_id, slot, 'shard-' || lpad(k::varchar, 2, '0') as shard
from documents join t on t.slot = (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})::int
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows outside of the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out()))
    found = language.identify(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.concat_ws(",", "langs").alias("langs"))


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, priced by the words of all documents."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.digest_spans(secrets.find_secrets(docs, secrets.learn_words(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guesses")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op5_chat_format"] = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + len(regexp_extract_all(text, '[~<>]')) as n, length(role) + len(regexp_extract_all(role, '[~<>]')) as m,
             coalesce(lag(role) over (partition by conv_id order by turn, role, text) != role, true) as opens from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       sum(n + case when opens then m + 8 else 3 end)::bigint as formatted_chars
from e group by conv_id
"""


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised, in sequences of 4096 tokens at most."""
    packed = packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by trigrams, the model learning outside of the held-out fold."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    held = language.held_out(folds=5, fold=1)
    model = lm.train(docs.filter(~held), order=3)
    return lm.score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op10_exact_dedup"] = r"""
with n as (select doc_id, length(coalesce(text, '')) as points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as normal from documents),
g as (select *, first_value(doc_id) over (partition by normal order by points desc, doc_id) as keep_id,
             count(*) over (partition by normal) as group_size from n)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(normal) as text_sha256 from g
"""


@query
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents: 3-word shingles, similarity of 0.85 or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, percent=85)


ORACLES["op7_minhash_near_dedup"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')]
             else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as u, b.doc_id as v, a.n as n, b.n as m, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select u, v from p where 100 * c >= 85 * (n + m - c)),
d as (select u, v from l union all select v, u from l),
r(node, seen) as (select doc_id, doc_id from documents union select d.v, r.seen from r join d on d.u = r.node where r.seen < d.v),
c as (select node, min(seen) as component_id from r group by node)
select s.doc_id, len(sh)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join c on c.node = s.doc_id
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, scores and ranks of every document, drawn towards the benchmark's texts."""
    drawn = resample.resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resampling"] = r"""
with recursive crc(i, v, k) as (select range, range::ubigint, 0 from range(256)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from crc where k < 8),
tab as (select list(v order by i) as codes from crc where k = 8),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dw as (select doc_id, unnest(ws) as w from d),
vocabulary as (select w, hex(encode(w)) as h from (select w from dw union select unnest(ws) from b)),
bucket as (select w, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint)),
                      lambda c, x: xor(c >> 8, codes[((xor(c, x) & 255) + 1)::bigint])), 4294967295::ubigint) % 10000 as k from vocabulary, tab),
s as (select k, count(*) as n from dw join bucket using (w) group by k),
t as (select k, count(*) as n from (select unnest(ws) as w from b) join bucket using (w) group by k),
g as (select range as k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double
                         / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
      from range(10000) left join s on s.k = range left join t on t.k = range),
w as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from dw join bucket using (w) join g using (k) group by doc_id),
f as (select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
             (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
      from d left join w using (doc_id)),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from f where n_features >= 20)
select f.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from f left join r using (doc_id)
"""


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return trie.build(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLES["op13_prefix_trie"] = r"""
with recursive crc(i, v, k) as (select range, range::ubigint, 0 from range(256)
    union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end, k + 1 from crc where k < 8),
tab as (select list(v order by i) as codes from crc where k = 8),
r as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
k as (select conv_id, turn, sha256(length(role) || ':' || role || text) as key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as tokens from r),
own as (select conv_id, list({'key': key, 'tokens': tokens} order by turn nulls first, key) as turns from k group by conv_id),
ids as (select conv_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(length(conv_id::varchar)), lambda i: ord(substr(conv_id::varchar, i + 1, 1))::ubigint)),
        lambda c, x: xor(c >> 8, codes[((xor(c, x) & 255) + 1)::bigint])), 4294967295::ubigint)::bigint % 4 as h from own, tab),
built as (select own.conv_id, list_concat(coalesce(d.turns[1:h], []), own.turns[h + 1:]) as turns
          from own join ids using (conv_id) left join own d on d.conv_id = own.conv_id - own.conv_id % 20),
p as (select conv_id, len(turns) as n, unnest(range(len(turns) + 1)) as depth, turns from built),
q as (select conv_id, n, depth, case when depth > 0 then sha256(array_to_string(list_transform(turns[1:depth], lambda t: t.key), ',')) end as node,
             case when depth > 1 then sha256(array_to_string(list_transform(turns[1:depth - 1], lambda t: t.key), ',')) end as parent,
             case when depth > 0 then turns[depth].tokens else 0 end as tokens from p),
g as (select depth, node, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(tokens) as saved,
             sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256 from q group by depth, node),
c as (select depth - 1 as depth, parent as node, count(*) as n_children from g where depth > 0 group by all),
x as (select g.*, coalesce(n_children, 0) as n_children from g left join c on c.depth = g.depth and c.node is not distinct from g.node),
s as (select q.depth, q.node, sum((x.n_children = 0)::int) as n_leaves, sum(x.saved) as saved_tokens
      from x join q on q.conv_id = x.conv_id and q.depth <= x.depth group by all)
select x.conv_id, x.depth, y.conv_id as parent_conv_id, x.n_convs, x.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, x.ends_sha256
from x join s on s.depth = x.depth and s.node is not distinct from x.node left join x y on y.depth = x.depth - 1 and y.node is not distinct from x.parent
"""


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels outside of the held-out fold."""
    docs, labels = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.learn(docs.filter(~language.held_out()), labels)
    found = toxicity.score(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
