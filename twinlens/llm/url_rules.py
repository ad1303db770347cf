"""URL filter: given host and path rules, and association rules that Spark's FP-growth mines from labelled urls.

An url becomes a set of tokens (parts of its host, path segments with digits masked, query keys). Itemsets of tokens and a
label give rules ``tokens => label``; tokens that always stand together count as one, so that their combinations make no
rules of their own. Rules of enough support and confidence match through an inverted index: a rule is filed under its rarest
token, an url looks up its own tokens and keeps the rules whose tokens it all has.

Results for odd input: null urls and urls without ``://`` have empty host and path and no tokens, so they get the default
verdict; repeated rows give repeated results; other columns are ignored. Nothing runs in Python.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.session import materialize

# Fixed values: (rule as host and path, verdict).
BASE_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LABEL = "label="


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens in order: every part of the host, its last two parts, path segments, query keys."""
    parts = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    masked = F.regexp_replace(F.translate(path(url), _UPPER, _LOWER), r"[0-9]+", "9")
    segments = F.filter(F.split(masked, "/"), lambda x: x != "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    named = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(kind), x))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(
        named("host:", parts), named("site:", F.array(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))),
        named("path:", segments), named("key:", keys)))), F.array().cast("array<string>"))


def base_rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits the host or a parent of it and the start of the path; null when none does."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(slash + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def always_together(labelled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Tokens in ``least`` rows or more, those that stand in the same rows as one item: (item, members, freq), the item being the
    first of its members; and (tokens, items): the items of every token set. Rows are told apart by 128 bits of hash."""
    sets = materialize(labelled.groupBy("tokens").agg(F.count("*").alias("rows")))
    each = sets.select("rows", F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit("together"), "tokens").alias("b"), F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.sum("rows").alias("freq"), F.count("*").alias("sets"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    classes = materialize(held.where(F.col("freq") >= least).groupBy("freq", "sets", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
                          .select(F.col("members")[0].alias("item"), "members", "freq"))
    items = (sets.select("tokens", F.explode("tokens").alias("item")).join(classes.select("item"), "item")
             .groupBy("tokens").agg(F.collect_list("item").alias("items")))
    return classes, materialize(items)


def mine_rules(labelled: DataFrame, support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, members, label, confidence, support, rarest) from rows (tokens, label), none of them null.

    Tokens that stand in the same labelled rows are one item, told by its first token; an url has the item if it has any of its
    tokens, which is what a rule for each of them would say. ``members`` are the tokens of every item of a rule, ``rarest``
    those of its rarest item. A rule is dropped when a part of its items says the same as surely.
    """
    classes, items = always_together(labelled, support * labelled.count())
    label = F.concat(F.lit(_LABEL), "label")
    rows = labelled.join(items, "tokens", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(label)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(rows)
    mined = materialize(
        model.associationRules.where(F.col("consequent")[0].startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .select(F.array_sort("antecedent").alias("tokens"), F.regexp_replace(F.col("consequent")[0], f"^{_LABEL}", "").alias("label"), "confidence", "support"))
    each = mined.select("tokens", "label", "confidence", F.explode("tokens").alias("token"))
    shorter = mined.select(F.col("tokens").alias("part"), F.col("label").alias("part_label"), F.col("confidence").alias("part_confidence"),
                           F.col("tokens")[0].alias("token"))
    implied = (each.join(shorter, "token").where((F.col("label") == F.col("part_label")) & (F.col("part_confidence") >= F.col("confidence"))
                                                 & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
               .select("tokens", "label").distinct())
    filed = (mined.select("tokens", "label", F.explode("tokens").alias("item")).join(classes, "item").groupBy("tokens", "label")
             .agg(F.min_by("members", F.struct("freq", "item")).alias("rarest"), F.array_sort(F.collect_list("members")).alias("members")))
    return materialize(mined.join(implied, ["tokens", "label"], "left_anti").join(filed, ["tokens", "label"]))


def match(urls: DataFrame, rules: DataFrame, most_broadcast: int = 16_000_000, salts: int = 16) -> DataFrame:
    """Rows (tokens) with their best rule: learned (label, confidence, rule tokens, as they stand in the url) or null.

    An index of at most ``most_broadcast`` bytes travels to the tasks; a larger one is joined by a shuffle on token and salt,
    so that an url token of very many urls is dealt to several tasks.
    """
    index = rules.select(F.explode("rarest").alias("token"), "members", "label", "confidence", "support")
    size = index.agg(F.sum(F.octet_length(F.concat_ws(" ", F.flatten("members"))) + 64)).first()[0] or 0
    pairs = urls.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token"))
    if size <= most_broadcast:
        met = pairs.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = pairs.withColumn("salt", F.pmod(F.xxhash64("tokens"), F.lit(salts)).cast("int")).join(salted, ["token", "salt"])
    own = F.array_sort(F.transform("members", lambda m: F.array_max(F.array_intersect(m, F.col("tokens")))))
    best = (met.where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("tokens"))))
            .groupBy("tokens").agg(F.max(F.struct("confidence", F.size("members").alias("size"), "support", "label", own.alias("rule_tokens"))).alias("learned")))
    # written, so that the join has a shuffle on both sides and a set of tokens of very many urls can be split
    return urls.join(materialize(best), "tokens", "left")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = BASE_RULES, labels: DataFrame | None = None, id_col: str = "page_id",
               url_col: str = "url", support: float = 0.005, confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """host, path, rule, verdict, learned (the association rule used) and confidence of every row.

    ``labels`` holds (id_col, label) for some rows; without it the verdicts of ``rules`` are the labels. An url with a
    fitting base rule keeps its verdict; else the surest learned rule decides, ties going to more tokens, more support,
    the later name; else ``default``.
    """
    url = F.col(url_col)
    parsed = pages.select(id_col, url.alias("_url"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("tokens"))
    parsed = parsed.withColumn("rule", base_rule(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string")
    for rule, verdict in rules:
        given = F.when(F.col("rule") == rule, verdict).otherwise(given)
    parsed = materialize(parsed.withColumn("given", given).drop("_url"))
    if labels is None:
        known = parsed.where(F.col("given").isNotNull()).select("tokens", F.col("given").alias("label"))
    else:
        known = parsed.join(labels.select(id_col, "label").where(F.col("label").isNotNull()), id_col).select("tokens", F.col("label").cast("string").alias("label"))
    known = known.where(F.size("tokens") > 0)
    if known.isEmpty():
        found = parsed.withColumn("learned", F.lit(None).cast("struct<confidence double, size int, support double, label string, rule_tokens array<string>>"))
    else:
        found = match(parsed, mine_rules(known, support, confidence))
    free = F.col("rule").isNull()
    return found.select(id_col, "host", "path", "rule", F.coalesce("given", "learned.label", F.lit(default)).alias("verdict"),
                        F.when(free, F.col("learned.rule_tokens")).alias("learned"), F.when(free, F.col("learned.confidence")).alias("confidence"))
