"""Personal data: exact patterns, and bootstrapped contextual extraction of further identifiers.

Base spans come from four fixed patterns with their checks. The method then looks at candidates:
names at a host, numbers with separators, and runs of letters and digits with a digit and at least
``SHORTEST`` characters; those that overlap a base span are left out. Every base span is a seed of its
kind; a run of ``KEY_LENGTH`` characters or more that mixes letters and digits, where something is assigned (after
``=`` or ``:`` and a quote, or after one of them), is a seed of a fifth kind, keys. An item competes for the kinds that its
form allows (``_forms``) in its contexts: the last one, two and three words before it, and the last one with what
follows it. Keys compete only in contexts of an assignment. For each kind, a bipartite graph of contexts and values is
scored until no further context is trusted: a context by the mean score of its values, a value by the best of its trusted
contexts (seeds stay at 1), so that what is found vouches for other contexts. Contexts with a score of
``CONFIDENCE`` and ``SUPPORT`` values or more for a kind discover the candidates in them
that compete for it; those are added under the kind ``id``.

All of it is DataFrame functions. Matches are exploded and placed by a running sum over one text's
matches, and what a base span touches by running extremes, so a text with very many is a few sorts, not an array
built step by step. The graph is summed by (context, value) before any shuffle, so a context that holds a third of all
candidates is one row for each of its values; joins on contexts can be split where they are skewed.

The patterns carry possessive quantifiers and a look-behind (or ``\\G``): with them a failed start is not
tried again inside the same run, and long runs neither take quadratic time nor deep recursion. They
match what the plain patterns match.

Edge cases: a null text is empty; rows of one doc_id and text get equal results; an empty list of
spans is the empty string; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontam import row_key
from .scratch import Scratch

_LOCAL = "A-Za-z0-9._%+-"
#: Kind, its pattern, and a quick test that every text with a match passes.
KINDS: tuple[tuple[str, str, str], ...] = (
    ("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]++\."),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
SHORTEST = 8
_AT, _DOT = r"(?:@|\x20?[(\[](?i:at)[)\]]\x20?|\x20(?i:at)\x20(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\x20?[(\[](?i:dot)[)\]]|\x20(?i:dot)\x20)))", r"(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?|\x20(?i:dot)\x20)"
#: A name at a host, also spelled out; a number of 2 to 10 groups of digits; a run of letters and digits.
CANDIDATE = "|".join(
    (
        rf"(?<![{_LOCAL}])[{_LOCAL}]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+",
        r"(?<![A-Za-z0-9])(?<![0-9][\x20.()/-]{1,2})\+?\(?[0-9]++(?:[\x20.()/-]{1,2}+[0-9]++){1,9}+(?![A-Za-z0-9])(?![\x20.()/-]{1,2}[0-9])",
        rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{SHORTEST},}}+",
    )
)
_SPELLED = r"(?i)[(\[]at[)\]]|\x20at\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\x20?[(\[]dot|\x20dot\x20)"
#: A candidate number has so many digits, or three groups with dots between them.
DIGITS = (7, 20)
#: From this length on a run of letters and digits is a key where something is assigned.
KEY_LENGTH = 20
CONFIDENCE, SUPPORT = 0.6, 3
#: Rounds after which the graph is taken as it is; each round but the last trusts a further context.
MOST_ROUNDS = 20
#: The last three words of a text, or fewer, and what is joined to the match.
_TAIL = r"(?<![^\s])(?:[^\s]++\s++){0,3}+[^\s]*+\z"
_ASSIGNED = r"[=:]\s*[\"']?\z"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _matches(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, nth, gap: characters since the last match, value, before: the last words of them, after: what follows)."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(
        F.arrays_zip(values.alias("v"), F.slice(gaps, F.lit(1), F.size(values)).alias("g"), F.slice(gaps, F.lit(2), F.size(values)).alias("n")),
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(m["g"]).alias("gap"), m["v"].alias("value"),
            F.lower(F.regexp_extract(m["g"], _TAIL, 0)).alias("before"), F.lower(F.regexp_extract(m["n"], r"\A(?:\s?[^\s]{1,16})?", 0)).alias("after"),
        ),
    )


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


#: The kind of keys, after the base kinds; candidates have the same number.
KEY = len(KINDS)
_DOTTED, _NUMBER = r"\A[0-9]+(?:\.[0-9]+){2,}\z", r"\A[0-9+()\x20./-]+\z"


def _forms(kind: Column, value: Column) -> Column:
    """The kinds that an item competes for: a base span for its own too."""
    kinds = lambda *k: F.array(*map(F.lit, k))
    plain = value.rlike(r"\A[A-Za-z0-9]+\z")
    form = F.when(value.rlike(_DOTTED), kinds(1, 2, 3)).when(value.rlike(_NUMBER), kinds(2, 3)).when(plain, kinds(0, 1, 2, 3)).otherwise(kinds(0))
    return F.when(kind < len(KINDS), F.array_union(F.array(kind), form)).when(plain, F.array_append(form, F.lit(KEY))).otherwise(form)


def _is_key(value: Column) -> Column:
    return (F.length(value) >= KEY_LENGTH) & value.rlike(r"\A[A-Za-z0-9]+\z") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def _valid(kind: Column, value: Column) -> Column:
    card, phone = F.regexp_replace(value, "[ -]", ""), F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind == 0, True)
        .when(kind == 1, value.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"))
        .when(kind == 2, F.when(F.length(card).between(14, 19), _luhn(card)).otherwise(False))
        .when(kind == 3, F.length(phone).between(10, 15))
        .otherwise(~value.rlike(_NUMBER) | value.rlike(_DOTTED) | value.rlike(rf"\A[0-9]{{{SHORTEST},}}\z") | F.length(phone).between(*DIGITS))
    )


def spans(docs: DataFrame) -> DataFrame:
    """Valid base matches (kind 0 to 3) and candidates (kind 4): row key, kind, start, end, value, contexts, kinds competed for."""
    text, none = F.col("text"), F.array().cast("array<struct<kind:int,nth:int,gap:int,value:string,before:string,after:string>>")
    tried = [F.when(text.rlike(quick), _matches(text, k, pattern)).otherwise(none) for k, (_, pattern, quick) in enumerate(KINDS)]
    tried.append(F.when(text.rlike(r"[0-9@]") | text.rlike(_SPELLED), _matches(text, len(KINDS), CANDIDATE)).otherwise(none))
    each = docs.filter(text.rlike(r"[0-9@]") | text.rlike(_SPELLED)).select(*row_key(), F.explode(F.concat(*tried)).alias("m"))
    each = each.distinct()  # repeated rows say the same
    each = each.select("__id", "__h", "__c", "m.*")
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("__id", "__h", "__c", "kind").orderBy("nth"))
    # the last words before it with what stands between them and the candidate; no words, no context
    words = [F.regexp_extract("before", rf"(?<![^\s])(?:[^\s]++\s++){{{n}}}+\z|(?<![^\s])(?:[^\s]++\s++){{{n - 1}}}+[^\s]++\z", 0) for n in (1, 2, 3)]
    told = [(n, w) for n, w in enumerate(words, 1)] + [(4, F.when((words[0] != "") & (F.col("after") != ""), F.concat(words[0], F.lit("\n"), F.col("after"))).otherwise(""))]
    assigned = F.col("before").rlike(_ASSIGNED)
    contexts = F.array_compact(F.array(*[F.when(w != "", F.xxhash64(F.lit(n), w)) for n, w in told]))
    placed = each.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("value")).filter(_valid(F.col("kind"), F.col("value")))
    forms = F.filter(_forms(F.col("kind"), F.col("value")), lambda f: (f != KEY) | assigned)
    key = (F.col("kind") == KEY) & assigned & _is_key(F.col("value"))
    return placed.select("__id", "__h", "__c", "kind", "start", "end", F.xxhash64("value").alias("value"), contexts.alias("contexts"), forms.alias("forms"), key.alias("key"))


def _trusted(items: DataFrame, scratch: Scratch) -> DataFrame:
    """Contexts and the kinds for which the graph trusts them, from items (form, context, value, seed)."""
    graph = scratch.write(items.groupBy("form", "context", "value").agg(F.max("seed").alias("seed")), "graph")
    values = graph.groupBy("form", "value").agg(F.max("seed").cast("double").alias("s"))
    before = -1
    for k in range(MOST_ROUNDS):
        contexts = graph.join(values, ["form", "value"]).groupBy("form", "context").agg(F.avg("s").alias("p"), F.count(F.lit(1)).alias("n"))
        trusted = scratch.write(contexts.filter((F.col("p") >= CONFIDENCE) & (F.col("n") >= SUPPORT)), f"trusted{k}")
        found = trusted.count()
        if found <= before:
            break
        before = found
        # a value is worth the best of its trusted contexts; a seed stays one. The next round reads this once, so only contexts are written
        values = graph.join(trusted, ["form", "context"], "left").groupBy("form", "value").agg(F.greatest(F.max("seed").cast("double"), F.coalesce(F.max("p"), F.lit(0.0))).alias("s"))
    return trusted.select("form", "context")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    key, last = ["__id", "__h", "__c"], len(KINDS)
    found = scratch.write(spans(docs), "spans")
    # a base span touches a candidate if one that began before it ends later, or one begins within it
    by_start = Window.partitionBy(*key).orderBy("start")
    own = lambda c: F.when(F.col("kind") < last, F.col(c))
    ends, following = F.max(own("end")).over(by_start.rangeBetween(Window.unboundedPreceding, 0)), F.min(own("start")).over(by_start.rangeBetween(1, Window.unboundedFollowing))
    touched = F.coalesce(F.col("__ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("__next") < F.col("end"), F.lit(False))
    items = found.withColumn("__ends", ends).withColumn("__next", following).filter((F.col("kind") < last) | ~touched).drop("__ends", "__next")
    by_text = found.filter(F.col("kind") < last).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("base"))
    items = scratch.write(items.select("*", F.explode("contexts").alias("context")).drop("contexts").select("*", F.explode("forms").alias("form")).drop("forms"), "items")
    seed = F.when(F.col("form") == KEY, F.col("key")).otherwise(F.col("kind") == F.col("form"))
    trusted = _trusted(items.withColumn("seed", seed), scratch)
    fresh = items.filter(F.col("kind") == last).join(trusted, ["form", "context"], "left_semi")
    added = fresh.groupBy(*[F.col(c).alias(f"{c}3") for c in key]).agg(F.collect_set(F.struct("start", F.lit(last).alias("kind"), "end")).alias("added"))
    same = lambda x: [F.col(c).eqNullSafe(F.col(f"{c}{x}")) for c in key]
    all_of = by_text.join(added, same(3), "full").select(*[F.coalesce(c, f"{c}3").alias(c) for c in key], "base", "added")
    rows = docs.select("doc_id", *[c.alias(f"{n}2") for c, n in zip(row_key(), key, strict=True)])
    joined = rows.join(all_of, same(2), "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    base = F.coalesce("base", none)
    names = F.array(*[F.lit(n) for n, _, _ in KINDS], F.lit("id"))
    told = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, _, _) in enumerate(KINDS)],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.sort_array(F.concat(base, F.coalesce("added", none)))).alias("spans"),
    )
