"""Message templates: mining, matching and event ids."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.text import mask, tokens
from eventloom.operators.ordered import broadcast_if_small, positions
from eventloom.session import cut_lineage

# Settings of the template miner.
WILDCARD = "<*>"
SIMILARITY = 0.4
LEADING_TOKENS = 1
#: Branches of a node, the wildcard's included.
MAX_CHILDREN = 100
#: Templates above which a literal that they share is looked up by broadcast.
HOT_LITERAL = 100_000

#: Parts that the distinct messages of a leaf are dealt into.
PARTS = 64
TEMPLATE_DDL = "leaf STRING, template ARRAY<STRING>, first_key STRING, messages BIGINT"


def masked_tokens(content: Column) -> Column:
    return tokens(mask(content))


def _lead(words: Column) -> Column:
    """The leading token that decides the branch: null for a single word, the wildcard for tokens with digits."""
    lead = F.get(words, F.lit(0))
    branch = F.when(lead.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(lead)
    return F.when(F.size(words) > LEADING_TOKENS, branch)


def _routed(distinct: DataFrame, children: int) -> DataFrame:
    """Add ``leaf`` to distinct messages: their token count and leading token.

    Of each token count the ``children - 1`` leading tokens that appear first have a leaf of their own; tokens with
    digits and all later ones share the leaf of the wildcard.
    """
    named = distinct.withColumn("_size", F.size("template")).withColumn("_lead", _lead(F.col("template")))
    literal = named.where((F.col("_lead") != WILDCARD) & F.col("_lead").isNotNull())
    firsts = literal.groupBy("_size", "_lead").agg(F.min("first_key").alias("_first"))
    # a limit by rank: each task passes on the first ones of a token count only
    place = F.row_number().over(Window.partitionBy("_size").orderBy("_first", "_lead"))
    own = firsts.withColumn("_place", place).where(F.col("_place") <= children - 1).select("_size", "_lead", F.lit(True).alias("_own"))
    routed = named.join(own, ["_size", "_lead"], "left")
    branch = F.when(F.col("_own"), F.col("_lead")).when(F.col("_lead").isNotNull(), F.lit(WILDCARD)).otherwise("")
    return routed.withColumn("leaf", F.concat_ws(" ", F.col("_size").cast("string"), branch)).drop("_size", "_lead", "_own")


def _sort_text(column: Column, kind: T.DataType) -> Column:
    """Text that sorts like the (non-negative) column; fields of a struct one after the other."""
    if isinstance(kind, T.StructType):
        return F.concat_ws("\x01", *[_sort_text(column[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.StringType):
        return column
    number = F.unix_micros(column.cast("timestamp")) if "timestamp" in kind.typeName() else column
    return F.lpad(number.cast("bigint").cast("string"), 20, "0")


def _generalise(leaf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Fold the messages of one leaf, in order, into templates.

    All messages of a leaf have one length, so the templates so far are the rows of one matrix of token numbers
    and a message is compared with all of them at once.
    """
    leaf = leaf.sort_values("first_key", kind="stable")
    rows = [list(words) for words in leaf["template"]]
    number = {WILDCARD: 0}
    coded = np.array([[number.setdefault(w, len(number)) for w in words] for words in rows], np.int64).reshape(len(rows), -1)
    found, messages, first = np.zeros((16, coded.shape[1]), np.int64), [], []
    for words, key, count in zip(coded, leaf["first_key"], leaf["messages"], strict=True):
        known = found[: len(first)]
        if len(known):
            literal = ((known == words) & (known != 0)).sum(axis=1)
            # the most literals in common, then the most wildcards, then the first
            best = int((literal * (coded.shape[1] + 1) + (known == 0).sum(axis=1)).argmax())
            if literal[best] >= similarity * coded.shape[1]:
                known[best][known[best] != words] = 0
                messages[best] += count
                continue
        if len(first) == len(found):
            found = np.concatenate([found, np.zeros_like(found)])
        found[len(first)] = words
        first.append(key)
        messages.append(count)
    names = list(number)
    return pd.DataFrame(
        {
            "leaf": leaf["leaf"].iloc[0],
            "template": [[names[x] for x in row] for row in found[: len(first)].tolist()],
            "first_key": first,
            "messages": messages,
        }
    )


def mine_templates(
    messages: DataFrame,
    content: str = "content",
    order: Iterable[str] = ("timestamp", "line_key"),
    similarity: float = SIMILARITY,
    max_clusters: int | None = None,
    words: str | None = None,
    children: int = MAX_CHILDREN,
) -> DataFrame:
    """Mine templates: ``event_id`` (dense, first seen first), ``template``, ``messages``.

    Equal masked messages are first counted together, so work after the first shuffle follows the number
    of distinct messages. The messages of a leaf are dealt by their hash into ``PARTS`` parts, whatever their number;
    each part is folded in order, then the parts' templates are. Templates so depend on the messages alone, not on
    their number or partitioning. A token count has at most ``children`` leaves (``_routed``). ``words`` names a column of masked tokens, if they exist already; more than
    ``max_clusters`` templates, where it is given, are an error.
    """
    if children < 1:
        raise ValueError("a node needs at least the wildcard's branch")
    distinct = _routed(cut_lineage(_distinct(messages, F.col(words) if words else masked_tokens(F.col(content)), order)), children)

    def fold(leaf: pd.DataFrame) -> pd.DataFrame:
        return _generalise(leaf, similarity)

    part = F.pmod(F.xxhash64(F.array_join("template", " ")), F.lit(PARTS))
    folded = distinct.withColumn("_part", part).groupBy("leaf", "_part").applyInPandas(fold, TEMPLATE_DDL)
    # parts of one leaf mostly find the same templates
    met = folded.groupBy("leaf", "template").agg(F.min("first_key").alias("first_key"), F.sum("messages").alias("messages"))
    # read by the numbering and by the caller
    merged = cut_lineage(met.groupBy("leaf").applyInPandas(fold, TEMPLATE_DDL))
    numbered = positions(merged, [], ["first_key", "leaf"], name="event_id").withColumn("event_id", F.col("event_id").cast("int"))
    if max_clusters is not None:
        over = F.raise_error(F.lit(f"more than {max_clusters} templates: mask more or raise the limit")).cast("int")
        numbered = numbered.withColumn("event_id", F.when(F.col("event_id") < max_clusters, F.col("event_id")).otherwise(over))
    return numbered.select("event_id", "template", "messages", "first_key")


def _distinct(messages: DataFrame, words: Column, order: Iterable[str]) -> DataFrame:
    """(template, first_key, messages) of the distinct token lists that are not empty."""
    key = [_sort_text(F.col(c), messages.schema[c].dataType) for c in order]
    keyed = messages.select(words.alias("template"), F.concat_ws("|", *key).alias("_key"))
    distinct = keyed.groupBy("template").agg(
        F.min("_key").alias("first_key"), F.count(F.lit(1)).alias("messages"), F.max(F.size("template")).alias("_words")
    )
    return distinct.filter(F.col("_words") > 0).drop("_words")


def leaf_sizes(
    messages: DataFrame, content: str = "content", order: Iterable[str] = ("timestamp", "line_key"), children: int = MAX_CHILDREN
) -> DataFrame:
    """Messages and distinct masked messages per leaf, to see how even the mining work is."""
    distinct = _routed(cut_lineage(_distinct(messages, masked_tokens(F.col(content)), order)), children)
    return distinct.groupBy("leaf").agg(F.sum("messages").alias("messages"), F.count(F.lit(1)).alias("distinct_messages"))


def template_index(templates: DataFrame) -> DataFrame:
    """(size, at, token, event_id, template): every template under its rarest literal, the one that fewest templates share.

    Literals are told apart by the token count and their place. A template of wildcards alone lies at place -1.
    """
    sized = templates.select("event_id", "template", F.size("template").alias("size"))
    literals = sized.select("event_id", "size", F.posexplode("template").alias("at", "token")).where(F.col("token") != WILDCARD)
    literal = ["size", "at", "token"]
    shared = cut_lineage(literals.groupBy(*literal).agg(F.count(F.lit(1)).alias("n")))
    # at most literals / HOT_LITERAL rows, which don't bring their templates together in one task
    hot = F.broadcast(shared.where(F.col("n") > HOT_LITERAL))
    cold = literals.join(hot, literal, "left_anti").join(shared.where(F.col("n") <= HOT_LITERAL), literal)
    rarest = (
        literals.join(hot, literal)
        .unionByName(cold)
        .groupBy("event_id")
        .agg(F.min(F.struct("n", "at", "token")).alias("key"))
        .select("event_id", F.col("key.at").alias("at"), F.col("key.token").alias("token"))
    )
    return sized.join(rarest, "event_id", "left").select(
        "size", F.coalesce("at", F.lit(-1)).alias("at"), F.coalesce("token", F.lit(WILDCARD)).alias("token"), "event_id", "template"
    )


def offers(distinct: DataFrame, index: DataFrame, words: str) -> DataFrame:
    """(words, size, at, token) of each list, for the places where templates of its length wait."""
    # a row for each token count, with as many places at most
    places = F.broadcast(index.groupBy("size").agg(F.collect_set("at").alias("_places")))
    offered = F.transform("_places", lambda at: F.struct(at.alias("at"), F.when(at < 0, WILDCARD).otherwise(F.get(words, at)).alias("token")))
    return (
        distinct.select(words, F.size(words).alias("size"))
        .join(places, "size")
        .select(words, "size", F.explode(offered).alias("o"))
        .select(words, "size", "o.at", "o.token")
    )


def matches(distinct: DataFrame, templates: DataFrame, words: str, prefer: str = "wildcards") -> DataFrame:
    """(words, cluster_id) of the distinct token lists that agree with a template, by equality on its rarest literal.

    Each template waits at one place, each list offers its tokens of the places where templates of its length wait, and only
    pairs that meet there are compared in full, so the work follows the lists and not lists times templates. Words that
    most lists have at a place where none waits do not move, nor come together in one task.
    """
    if prefer not in ("literals", "wildcards"):
        raise ValueError("prefer must be literals or wildcards")
    index = cut_lineage(template_index(templates))
    met = offers(distinct, index, words).join(broadcast_if_small(index), ["size", "at", "token"])
    pairs = F.zip_with(F.col(words), F.col("template"), lambda t, p: (t == p) | (p == WILDCARD))
    literals = F.size(F.filter("template", lambda t: t != WILDCARD))
    wanted = -literals if prefer == "literals" else literals
    agreed = met.where(F.forall(pairs, lambda ok: ok)).select(words, F.struct(wanted.alias("w"), F.col("event_id").alias("id")).alias("_c"))
    return agreed.groupBy(words).agg(F.min("_c").alias("_c")).select(words, F.col("_c.id").alias("cluster_id"))


def match_templates(
    messages: DataFrame, templates: DataFrame, words: str = "tokens", prefer: str = "wildcards"
) -> DataFrame:
    """Add ``cluster_id``: the template every token agrees with, else null.

    Distinct token lists are matched once (``matches``) and the ids go back by list, so a message is never compared
    with a template itself. Ties go to the template with most wildcards, as in mining (or most ``literals``),
    then to the lowest id. ``event_id`` of the templates must be unique; null token lists match nothing.
    """
    distinct = messages.where(F.col(words).isNotNull()).select(words).distinct()
    found = cut_lineage(matches(distinct, templates, words, prefer))
    known = found.select(F.col(words).alias("_words"), "cluster_id")
    return messages.join(broadcast_if_small(known), F.col(words) == F.col("_words"), "left").drop("_words")


def dense_ids(labels: DataFrame, label: str, first_key: str) -> DataFrame:
    """Label -> dense id by first appearance, with ``unknown`` appended last. For small vocabularies."""
    firsts = labels.groupBy(F.col(label).cast("string").alias("label")).agg(F.min(first_key).alias("_k"))
    ids = firsts.select(
        "label", (F.row_number().over(Window.orderBy("_k", "label")) - 1).cast("int").alias("event_id")
    )
    unknown = ids.agg(F.lit("unknown").alias("label"), F.count(F.lit(1)).cast("int").alias("event_id"))
    return ids.unionByName(unknown)


def to_event_ids(matched: DataFrame, vocabulary: DataFrame, column: str = "cluster_id") -> DataFrame:
    """Replace cluster ids by dense event ids; rows without one get the id of the label ``unknown``.

    That is the last one: a label of a message that happens to be spelled so is told apart by its smaller id. A
    vocabulary without it leaves such rows null.
    """
    named = F.max(F.when(F.col("label") == "unknown", F.col("event_id")))
    unknown = vocabulary.agg(named.alias("_unknown"))
    known = vocabulary.groupBy(F.col("label").alias("_label")).agg(F.min("event_id").alias("event_id"))
    looked_up = matched.join(broadcast_if_small(known), F.col(column).cast("string") == F.col("_label"), "left")
    # one row on the right
    return looked_up.crossJoin(F.broadcast(unknown)).withColumn("event_id", F.coalesce("event_id", "_unknown")).drop("_unknown", "_label")


def with_template_text(df: DataFrame, templates: DataFrame, event: str = "event_id") -> DataFrame:
    """Add the template text of an event, null when unknown."""
    texts = templates.select(F.col("event_id").alias(event), F.col("template_text"))
    return df.join(broadcast_if_small(texts), event, "left")
