"""Quotation linking: replies found by what they quote, conversations without quotes.

Lines that start with ``>`` marks are quotes; runs of one level are passages. Normalised
passages, their paragraphs, lines and sentences (however wrapped) are hashed and joined with the hashes of what earlier messages
of the conversation say themselves; the first message that says it is the original. A
message replies to the original of its shallowest, then longest passage.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.workers import prepare
from tabulon.session import materialise

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
_ATTRIBUTION = re.compile(r".*\b(?:wrote|writes|said)[ \t]*:[ \t]*", re.IGNORECASE)
_SENTENCE_END = re.compile("[.!?][\"')\\]\u201d\u2019]*$")
#: Lines and sentences of fewer words do not stand for a message by themselves.
LEAST_LINE_WORDS = 3


def _hash(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "little", signed=True)


def _words(text: str) -> list[str]:
    """Normal form: lower case, single blanks."""
    return text.lower().split()


def passages(lines: list[str]) -> list[tuple[int, int]]:
    """(hash, words) of the whole, its paragraphs, its longer lines and longer sentences.

    A sentence ends with a word that ends in ``.``, ``!`` or ``?``, perhaps before a closing
    mark, or with its paragraph; line breaks do not matter.
    """
    found = {}
    whole = _words("\n".join(lines))
    if whole:
        found[_hash(whole)] = len(whole)
    paragraph: list[str] = []
    for line in [*lines, ""]:
        words = _words(line)
        if len(words) >= LEAST_LINE_WORDS:
            found[_hash(words)] = len(words)
        if words:
            paragraph += words
        elif paragraph:
            found[_hash(paragraph)] = len(paragraph)
            start = 0
            for at, word in enumerate(paragraph, 1):
                if at == len(paragraph) or _SENTENCE_END.search(word):
                    if at - start >= LEAST_LINE_WORDS:
                        found[_hash(paragraph[start:at])] = at - start
                    start = at
            paragraph = []
    return list(found.items())


def parse_message(text: str | None) -> tuple[str, list[tuple[int, int, int]], int]:
    """(own text, (level, hash, words) of what it quotes, number of quoted passages).

    A line such as "A wrote:" right before a quote goes with it.
    """
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    before = 0
    for line in (text or "").splitlines():
        match = _QUOTE.fullmatch(line)
        level = match.group(1).count(">") if match else 0
        if not level:
            own.append(line)
        else:
            if not before and own and _ATTRIBUTION.fullmatch(own[-1]):
                own.pop()
            if level == before:
                runs[-1][1].append(match.group(2))
            else:
                runs.append((level, [match.group(2)]))
        before = level
    quoted = [(level, h, n) for level, lines in runs for h, n in passages(lines)]
    return "\n".join(own).strip(), quoted, len(runs)


def _parsed(batches):
    struct = pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("words", pa.int32())])
    for batch in batches:
        own, quoted, count, said = [], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            content, quotes, n = parse_message(text)
            own.append(content), count.append(n), said.append([h for h, _ in passages(content.split("\n"))])
            quoted.append([{"level": a, "hash": b, "words": c} for a, b, c in quotes])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(own, pa.string()), pa.array(quoted, pa.list_(struct)), pa.array(count, pa.int32()), pa.array(said, pa.list_(pa.int64()))],
            [*batch.schema.names, "content", "quotes", "n_quotes", "said"],
        )


def _roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of messages that reply, by doubling the way up each round."""
    table = materialise(replies.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = table.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = materialise(
            table.join(up, ["conv", "root"], "left")
            .select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"))
        )
        table = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return table


def link_quotations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per message: (conv_id, turn, role, parent_turn, root_turn, depth, n_quotes, content, formatted).

    Sorted by conv_id, root_turn, turn, a conversation is in reply order: a message comes
    after what it replies to and threads follow each other. ``content`` is the message
    without quotes, ``formatted`` the same behind its role. A message without a linked quote
    starts a thread (depth 0). Null texts are empty; null conversations or turns link with
    nothing; equal rows get equal results; of several parents for one (conversation, turn)
    the first counts.
    """
    prepare(messages.sparkSession)
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("text"),
    ).withColumn("row", F.xxhash64("conv", "turn", "role", "text"))
    quote = "array<struct<level:int,hash:long,words:int>>"
    parsed = materialise(
        rows.mapInArrow(_parsed, f"conv long, turn long, role string, text string, row long, content string, quotes {quote}, n_quotes int, said array<long>").drop("text")
    )
    placed = parsed.where("conv IS NOT NULL AND turn IS NOT NULL")
    asked = placed.where("size(quotes) > 0").select("row", "conv", "turn", F.explode("quotes").alias("q")).select("row", "conv", "turn", "q.*").distinct()
    asked = materialise(asked)
    wanted = asked.select("conv", "hash").distinct()
    said = placed.select("conv", "turn", F.explode("said").alias("hash")).groupBy("conv", "hash").agg(F.min("turn").alias("first"))
    originals = said.join(wanted, ["conv", "hash"], "left_semi")
    message = ["conv", "turn", "row"]  # the hash only tells rows of one turn apart
    order = F.struct((-F.col("level")).alias("level"), "words", F.col("first").alias("turn"))
    best = materialise(
        asked.join(originals, ["conv", "hash"]).where("first < turn").groupBy(*message).agg(F.max(order).alias("best"))
        .select(*message, F.col("best.turn").alias("parent"))
    )
    linked = placed.select(*message).distinct().join(best, message)
    roots = _roots(linked.groupBy("conv", "turn").agg(F.min("parent").alias("parent")))
    out = parsed.join(best, message, "left").join(roots, ["conv", "turn"], "left")
    named = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), "n_quotes", "content", named.alias("formatted"),
    )
