"""Categorical standardisation: clusters of values that mean the same.

Only columns with few distinct values take part, so a column's value table (value, count, first position) is small by
definition (VALUES at most) and pairs of it may be compared. Its result is a map, applied to all rows as a projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import ascii_clean, canonical_key, distinct_entities, text, token_key, ws_trim
from millrace.operators.missing import is_text
from millrace.stable import stable

# Texts that mean "missing" in categories; words that initials leave out; limits of what is a category.
SENTINELS = [
    "", "null", "none", "nan", "na", "n/a", "n.a.", "n/d", "-", "--", "---", "?", "??", "???", "????", ".", "..", "...", "unknown", "missing",
    "#n/a", "#na", "#null!", "undefined", "nil", "blank",
]
SMALL_WORDS = ["of", "the", "and", "in", "for", "on", "at", "to", "a", "an"]
VALUES, CONTEXT_VALUES = 250, 50


def value_table(df: DataFrame, column: str, order_by: list[str] | None = None) -> DataFrame:
    """(value, n, first) of the non-null values; first is the smallest order key, or the value itself."""
    first = F.min(F.struct(*[F.col(c) for c in order_by])) if order_by else F.min(F.struct(text(column)))
    return df.filter(F.col(column).isNotNull()).groupBy(text(column).alias("value")).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))


def categorical_columns(df: DataFrame, most: int = VALUES) -> list[str]:
    """Text columns of 2 to `most` distinct values that are short and not nearly unique."""
    found = []
    for c in [c for c in df.columns if is_text(df, c)]:
        # Reading stops at the first value too many.
        values = df.filter(F.col(c).isNotNull()).select(text(c)).distinct().limit(most + 1).count()
        if not 2 <= values <= most:
            continue
        n = df.filter(F.col(c).isNotNull()).count()
        head = [r[0] for r in df.filter(F.col(c).isNotNull()).select(text(c)).limit(100).collect()]
        if not (n > 20 and values / n > 0.85) and sum(map(len, head)) / len(head) <= 60 and sum(len(v.split()) for v in head) / len(head) <= 8:
            found.append(c)
    return found


def null_sentinels(values: DataFrame) -> DataFrame:
    return values.filter(F.lower(ws_trim("value")).isin(SENTINELS))


def _case_rank(v: Column) -> Column:
    title = v.rlike(r"^\p{Lu}[^\p{Lu}]*(\s+\p{Lu}[^\p{Lu}]*)*$")
    return F.when(title, 2).when(v.rlike(r"\p{Lu}"), 1).otherwise(0)


def canonical_values(values: DataFrame, key: Column) -> DataFrame:
    """Add key, canonical (by count, case, words, then first position), members and total of each key's group."""
    w = Window.partitionBy("key")
    best = w.orderBy(F.col("n").desc(), _case_rank(F.col("value")).desc(), F.size(F.split("value", r"\s+")).desc(), F.col("first"), F.col("value"))
    keyed = values.withColumn("key", key)
    return keyed.withColumn("canonical", F.first("value").over(best)).withColumn("members", F.count(F.lit(1)).over(w)).withColumn("total", F.sum("n").over(w))


def format_variants(values: DataFrame) -> DataFrame:
    """(value, canonical, confidence, method) of values with the same letters and digits."""
    kept = values.filter(~F.lower(ws_trim("value")).isin(SENTINELS))
    grouped = canonical_values(kept, canonical_key("value")).filter((F.col("key") != "") & (F.col("members") > 1) & (F.col("value") != F.col("canonical")))
    same = F.lower(ascii_clean("value")) == F.lower(ascii_clean("canonical"))
    return grouped.select("value", "canonical", F.when(same, 0.98).otherwise(0.95).alias("confidence"), F.when(same, "whitespace_case").otherwise("punctuation").alias("method"), F.lit(False).alias("ambiguous"))


def canonicals(values: DataFrame) -> DataFrame:
    """One row for each canonical value: value, n (of its whole group), own (its own count), first."""
    kept = values.filter(~F.lower(ws_trim("value")).isin(SENTINELS))
    grouped = canonical_values(kept, canonical_key("value")).filter(F.col("key") != "")
    return grouped.filter(F.col("value") == F.col("canonical")).select("value", F.col("total").alias("n"), F.col("n").alias("own"), "first")


def token_permutations(canon: DataFrame, context: Column | float = 0.5) -> DataFrame:
    """Canonicals of the same words in another order."""
    grouped = canonical_values(canon.select("value", F.col("own").alias("n"), "first"), F.array_join(token_key("value"), " "))
    rows = grouped.filter((F.size(token_key("value")) >= 2) & (F.col("members") > 1) & (F.col("value") != F.col("canonical")))
    score = context if isinstance(context, Column) else F.lit(context)
    return rows.select("value", "canonical", F.round(F.lit(0.88) + score * 0.05, 2).alias("confidence"), F.lit("token_permutation").alias("method"), F.lit(False).alias("ambiguous"))


def _pairs(canon: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Pairs of a value table, by a theta join: both sides have VALUES rows at most, which is checked before."""
    a = canon.select(F.col("value").alias("a"), F.col("n").alias("na"), F.col("first").alias("fa"), F.col("own").alias("oa"))
    b = (other or canon).select(F.col("value").alias("b"), F.col("n").alias("nb"), F.col("first").alias("fb"), F.col("own").alias("ob"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b"))


#: Keys up to this length are indexed by what is left after deletions, longer ones by their thirds; lengths next to it by both.
DELETIONS_TO = 26


def _deleted(x: Column) -> Column:
    """All texts that are x less one character."""
    n = F.length(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, n)))).otherwise(F.array().cast("array<string>"))


def _thirds(x: Column, n: Column, shift: tuple[int, ...]) -> list[Column]:
    """The thirds that a text of length n is cut into, as marked pieces of x, moved by each shift."""
    size = F.floor(n / 3).cast("int")
    cuts = [(F.lit(0), size), (size, size), (2 * size, n - 2 * size)]
    return [F.when(at + d >= 0, F.concat_ws("|", n, F.lit(i), x.substr(at + d + 1, long))) for i, (at, long) in enumerate(cuts) for d in shift]


def near_keys(keys: DataFrame) -> DataFrame:
    """(x, y), x < y: all pairs of a table of distinct texts (`key`) that are at most two edits apart, without comparing all.

    Short texts meet in what is left of both after two deletions at most: texts two edits apart always share such a rest.
    Long ones meet in a third: of three pieces of a text, two edits leave one as it is, moved by two places at most.
    Both are equi-joins over exploded pieces; the edit distance then decides. Texts of less than 6 characters are only
    looked up with one deletion, as two edits change more than a quarter of them.
    """
    x, n = F.col("key"), F.length("key")
    one = _deleted(x)
    two = F.flatten(F.transform(one, _deleted))
    rests = F.array_distinct(F.concat(F.array(x), one, F.when(n >= 6, two).otherwise(F.array().cast("array<string>"))))
    short = keys.filter(n <= DELETIONS_TO).select("key", F.explode(rests).alias("piece"))
    long = keys.filter(n >= DELETIONS_TO - 1)
    index = long.select("key", F.explode(F.array(*_thirds(x, n, (0,)))).alias("piece"))
    probe = long.select(F.col("key").alias("other"), F.explode(F.array_compact(F.array(*[p for d in range(-2, 3) for p in _thirds(x, n + d, (-2, -1, 0, 1, 2))]))).alias("piece"))
    pairs = short.join(short.withColumnRenamed("key", "other"), "piece").unionByName(index.join(probe, "piece"))
    ordered = pairs.filter("key != other").select(F.least("key", "other").alias("x"), F.greatest("key", "other").alias("y")).distinct()
    return ordered.filter(F.levenshtein("x", "y", 2) >= 0)


def _near_pairs(canon: DataFrame) -> DataFrame:
    """_pairs() of values whose keys are at most two edits apart, by near_keys()."""
    keyed = canon.withColumn("key", canonical_key("value")).filter(F.length("key") >= 4)
    near = near_keys(keyed.select("key").distinct())
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    side = lambda s, k: keyed.select(F.col("key").alias(k), F.col("value").alias(s), F.col("n").alias(f"n{s}"), F.col("first").alias(f"f{s}"), F.col("own").alias(f"o{s}"))
    return both.join(side("a", "x"), "x").join(side("b", "y"), "y").drop("x", "y")


def fuzzy_typos(canon: DataFrame) -> DataFrame:
    """Values one or two edits apart; counts 3 to 1 make it safe, balanced ones need a review.

    A table of VALUES at most is compared pair by pair, a larger one by an index of pieces; the pairs are the same.
    """
    x, y = canonical_key("a"), canonical_key("b")
    found = _pairs(canon) if canon.limit(VALUES + 1).count() <= VALUES else _near_pairs(canon)
    pairs = found.filter((F.col("fa") < F.col("fb")) | ((F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b")))).withColumns({"x": x, "y": y})
    pairs = pairs.filter((F.length("x") >= 4) & (F.length("y") >= 4)).withColumn("d", F.levenshtein("x", "y")).withColumn("m", F.greatest(F.length("x"), F.length("y")))
    sim = 1 - F.col("d") / F.col("m")
    near = ((F.col("d") == 1) | ((F.col("d") == 2) & (F.col("m") >= 7))) & (sim >= 0.75)
    pairs = pairs.filter(near & ~distinct_entities(F.col("a"), F.col("b")))
    much = lambda p, q: (p >= 3 * q) | ((p >= 4) & (q <= 1))
    na, nb = F.col("na"), F.col("nb")
    safe, a_wins = much(na, nb) | much(nb, na), F.when(much(na, nb), True).when(much(nb, na), False).otherwise(na >= nb)
    return pairs.select(
        F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("value"), F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        F.when(safe, F.round(F.least(F.lit(0.95), F.lit(0.86) + sim * 0.08), 2)).otherwise(0.75).alias("confidence"), F.lit("fuzzy_typo").alias("method"), F.lit(False).alias("ambiguous"),
    )


def _resolve(pairs: DataFrame, confidence: Column, unsure: float, method: str) -> DataFrame:
    """One row for each short value: its only match, or the first of several as ambiguous."""
    grouped = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct("b", "ob", "oa"), F.struct("fb", "b")).alias("m"))
    sure = F.col("k") == 1
    return grouped.withColumns({"b": F.col("m.b"), "ob": F.col("m.ob"), "oa": F.col("m.oa")}).select(
        F.col("a").alias("value"), F.col("b").alias("canonical"), F.when(sure, F.round(confidence, 2)).otherwise(unsure).alias("confidence"),
        F.when(sure, method).otherwise(f"ambiguous_{method}").alias("method"), (~sure).alias("ambiguous"),
    )


def acronyms(canon: DataFrame, context: float = 0.5) -> DataFrame:
    """Short tokens that are the initials of a phrase, all or without small words."""
    words = F.filter(F.regexp_extract_all(text("b"), F.lit(r"\b[A-Za-z0-9]+"), 0), lambda w: w != "")
    initials = lambda ws: F.upper(F.array_join(F.transform(ws, lambda w: F.substring(w, 1, 1)), ""))
    short = F.upper(ascii_clean("a"))
    content = F.filter(words, lambda w: ~F.lower(w).isin(SMALL_WORDS))
    fits = F.length(short).between(2, 4) & ~F.contains(short, F.lit(" ")) & F.contains(ascii_clean("b"), F.lit(" ")) & ((short == initials(words)) | (short == initials(content)))
    return _resolve(_pairs(canon).filter(fits), F.lit(0.88 + 0.05 * context), 0.72, "acronym")


def prefixes(canon: DataFrame, taken: DataFrame | None = None, context: float = 0.5) -> DataFrame:
    """Truncations of three to five characters."""
    a, b = F.lower(ascii_clean("a")), F.lower(ascii_clean("b"))
    fits = F.length(a).between(3, 5) & ~F.contains(a, F.lit(" ")) & (F.length(b) >= F.greatest(F.length(a) + 2, F.lit(4))) & F.startswith(b, a) & ~distinct_entities(F.col("a"), F.col("b"))
    pairs = _pairs(canon).filter(fits)
    pairs = pairs.join(taken.select(F.col("value").alias("a")), "a", "left_anti") if taken is not None else pairs
    gain = F.when(F.col("ob") >= F.col("oa"), 0.05).otherwise(0.0)
    return _resolve(pairs, F.least(F.lit(0.90), F.lit(0.82) + gain + 0.04 * context), 0.70, "prefix")


def skeletons(canon: DataFrame, taken: DataFrame | None = None, context: float = 0.5) -> DataFrame:
    """Two to four characters that are, with the initial, an ordered part of a longer word and of its consonants."""
    a, b = F.lower(ascii_clean("a")), F.lower(ascii_clean("b"))
    bare = lambda x: F.regexp_replace(x, "[aeiou]", "")
    pattern = lambda x: F.concat(F.lit("^"), F.array_join(F.transform(F.split(x, ""), lambda ch: F.concat(F.lit("[^"), ch, F.lit("]*"), ch)), ""))
    plain = a.rlike(r"^[a-z0-9]{2,4}$")
    fits = plain & (F.length(b) > F.greatest(F.length(a) + 2, F.lit(3))) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    pairs = _pairs(canon).filter(fits & ~distinct_entities(F.col("a"), F.col("b"))).withColumns({"x": a, "y": b})
    pairs = pairs.filter(F.rlike("y", pattern(F.col("x"))) & ((bare(F.col("x")) == "") | F.rlike(bare(F.col("y")), pattern(bare(F.col("x"))))))
    pairs = pairs.join(taken.select(F.col("value").alias("a")), "a", "left_anti") if taken is not None else pairs
    gain = F.when(F.col("ob") >= F.col("oa"), 0.04).otherwise(0.0)
    return _resolve(pairs, F.least(F.lit(0.88), F.lit(0.80) + gain + 0.04 * context), 0.68, "skeleton")


def unresolved_codes(canon: DataFrame, resolved: DataFrame) -> DataFrame:
    """Upper-case codes without a match, for review."""
    code = ascii_clean("value").rlike(r"^\S{2,10}$") & ascii_clean("value").rlike("[A-Z]") & (ascii_clean("value") == F.upper(ascii_clean("value")))
    rest = canon.filter(code).join(resolved.select("value"), "value", "left_anti")
    return rest.select("value", F.col("value").alias("canonical"), F.lit(0.70).alias("confidence"), F.lit("unresolved").alias("method"), F.lit(True).alias("ambiguous"))


def user_mapping(values: DataFrame, mapping: dict[str, str]) -> DataFrame:
    table = values.sparkSession.createDataFrame([(k.lower(), v) for k, v in mapping.items()], "k string, canonical string")
    return values.join(F.broadcast(table), F.lower(ascii_clean("value")) == F.col("k")).select("value", "canonical", F.lit(1.0).alias("confidence"), F.lit("user").alias("method"), F.lit(False).alias("ambiguous"))


def context_scores(df: DataFrame, column: str, pairs: DataFrame, most: int = CONTEXT_VALUES) -> DataFrame:
    """(a, b, score): mean Jaccard similarity of what two values occur with in other small text columns; 0.5 if nothing."""
    others = [c for c in df.columns if c != column and is_text(df, c) and df.select(c).filter(F.col(c).isNotNull()).distinct().limit(most + 1).count() <= most]
    if not others:
        return pairs.select("a", "b", F.lit(0.5).alias("score"))
    sets = df.filter(F.col(column).isNotNull()).groupBy(text(column).alias("v")).agg(*[F.collect_set(c).alias(f"s{i}") for i, c in enumerate(others)])  # sets of `most` values
    names = [f"s{i}" for i in range(len(others))]
    left = sets.select(F.col("v").alias("a"), *[F.col(s).alias(f"a{s}") for s in names])
    right = sets.select(F.col("v").alias("b"), *[F.col(s).alias(f"b{s}") for s in names])
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    parts = F.array_compact(F.array(*[F.when((F.size(f"a{s}") > 0) & (F.size(f"b{s}") > 0), F.size(F.array_intersect(f"a{s}", f"b{s}")) / F.size(F.array_union(f"a{s}", f"b{s}"))) for s in names]))
    return both.select("a", "b", F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)).otherwise(0.5).alias("score"))


def proposals(df: DataFrame, column: str, order_by: list[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """All proposals of one column: value, canonical (null for "missing"), confidence, method, ambiguous; step tells their order."""
    values = value_table(df, column, order_by).persist()
    if values.limit(VALUES + 1).count() <= VALUES:  # bounded: in one partition, none of the many steps shuffles
        values = values.coalesce(1).persist()
    canon = canonicals(values).persist()
    sentinel = null_sentinels(values).select("value", F.lit(None).cast("string").alias("canonical"), F.lit(0.99).alias("confidence"), F.lit("null_sentinel").alias("method"), F.lit(False).alias("ambiguous"))
    acr = acronyms(canon)
    pre = prefixes(canon, acr)
    skel = skeletons(canon, acr.select("value").union(pre.select("value")))
    resolved = acr.select("value").union(pre.select("value")).union(skel.select("value"))
    steps = [sentinel, format_variants(values), token_permutations(canon), fuzzy_typos(canon), acr, pre, skel, unresolved_codes(canon, resolved)]
    steps += [user_mapping(values, mapping)] if mapping else []
    return reduce(DataFrame.unionByName, [s.withColumn("step", F.lit(i)) for i, s in enumerate(steps)])


def closed_map(rows: list, least: float = 0.85) -> dict[str, str | None]:
    """The map of accepted proposals, followed to its ends; a cycle stops where it closes; later proposals win."""
    direct = {r["value"]: r["canonical"] for r in sorted(rows, key=lambda r: r["step"]) if r["confidence"] >= least and not r["ambiguous"]}
    out = {}
    for start in direct:
        seen, at = {start}, direct[start]
        while at is not None and at in direct and at not in seen and direct[at] != at:
            seen.add(at)
            at = direct[at]
        out[start] = at
    return {k: v for k, v in out.items() if k != v}


def apply_map(df: DataFrame, column: str, mapping: dict[str, str | None]) -> DataFrame:
    """Replace values by a map of at most VALUES entries, as a literal."""
    if not mapping:
        return df
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.struct(F.lit(v).cast("string").alias("to")))])
    found = F.try_element_at(table, text(column))
    return df.withColumn(column, F.when(found.isNotNull(), found["to"]).otherwise(text(column)))


def standardize(df: DataFrame, columns: list[str] | None = None, least: float = 0.85, most: int = VALUES, mapping: dict[str, str] | None = None, order_by: list[str] | None = None) -> tuple[DataFrame, dict[str, dict]]:
    columns = columns if columns is not None else categorical_columns(df, most)
    maps = {c: closed_map(proposals(df, c, order_by, mapping).collect(), least) for c in columns}  # a few rows for each of 250 values
    out = df
    for c, m in maps.items():
        out = apply_map(out, c, m)
    return out, maps


def inconsistent_columns(df: DataFrame, least: float = 0.85) -> list[str]:
    return [c for c in categorical_columns(df) if not proposals(df, c).filter(F.col("confidence") >= least).isEmpty()]


def semantic_groups(found: DataFrame) -> DataFrame:
    """Proposals by canonical value, with the least confidence."""
    return found.filter("canonical is not null").groupBy("canonical").agg(F.array_sort(F.collect_set("value")).alias("members"), F.min("confidence").alias("confidence"))


def validated_groups(values: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposed groups (canonical, value, confidence) held against the column's values (value, n), such as a provider's.

    Members that the column doesn't have are dropped. Groups that share a member are one: they get the least canonical
    name of each other's until nothing changes, and go under the name that is most frequent in the column. A group is
    rejected (accepted is false) if a name or member of it must never merge with that name. One row for each group:
    canonical, members in order, the least confidence, accepted.
    """
    known = stable(proposed.join(values.select("value"), "value", "left_semi").select("canonical", "value", "confidence"))
    label = known.select("canonical", F.col("canonical").alias("root")).distinct()
    while True:
        by_value = known.join(label, "canonical").groupBy("value").agg(F.min("root").alias("least"))
        new = stable(known.join(by_value, "value").groupBy("canonical").agg(F.min("least").alias("root")))
        if new.join(label, ["canonical", "root"], "left_anti").isEmpty():
            break
        label = new
    names = label.join(values.select(F.col("value").alias("canonical"), "n"), "canonical", "left")
    best = names.groupBy("root").agg(F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("less"), "canonical")).alias("b")).select("root", F.col("b.canonical").alias("name"))
    rows = known.join(label, "canonical").join(best, "root")
    apart = lambda c: (F.col(c) != F.col("name")) & F.coalesce(distinct_entities(F.col(c), F.col("name")), F.lit(False))
    return rows.groupBy(F.col("name").alias("canonical")).agg(
        F.array_sort(F.collect_set("value")).alias("members"), F.min("confidence").alias("confidence"), (~F.bool_or(apart("value") | apart("canonical"))).alias("accepted")
    )
