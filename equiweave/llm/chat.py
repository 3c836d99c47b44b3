"""Chat formatting with prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are its context and only its
reply is trainable. Writing each context out would take the square of a conversation's length, so
the output keeps one formatted string for each conversation, cut into one piece for each turn, and
an example as three places in it: its context is [0, loss_start), its target [loss_start,
loss_end). `example_texts` writes examples out where they are wanted as strings.

Template: ``<s>[INST] role`` newline, the text, ``[/INST]</s>`` for each turn. Inside roles and texts a
backslash is put before every backslash and after the first character of every control string, so
that no control string is left; dropping each backslash that starts such a pair restores the text.
A line break inside a role is written as backslash and n.

Pieces and places are made by column functions alone: places are running sums over runs of RUN turn
numbers, whose totals are summed by conversation, so a conversation that is a third of all rows is
many tasks. The reader, whose digests need a conversation's texts in order, streams through them as
one sorted run, holding one batch and the state of two hashes.

Defined cases: null text and null role are empty; turns go by number (null first), then role, then
text, so repeated rows are repeated turns; a null conv_id is a conversation; roles other than
assistant are never trainable; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Strings that mark turns in this and other common chat templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, BREAK, CLOSE = "<s>[INST] ", "\n", "[/INST]</s>"
TRAINED = "assistant"
#: Turn numbers whose places one task sums.
RUN = 1024
_STARTS = r"([<\[])(?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}, key=lambda x: (-len(x), x))) + ")"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _STARTS, r"$1\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def demo(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -7, whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return made.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")])


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, seq (from 0), piece, start, loss_start and loss_end (code points; null without loss) of each turn."""
    base = turns.select(
        "conv_id", "turn", F.floor(F.col("turn") / RUN).cast("long").alias("run"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    lead = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(BREAK))
    base = base.withColumn("lead", F.length(lead)).withColumn("body", F.length(escape(F.col("text")))).withColumn("chars", F.col("lead") + F.col("body") + len(CLOSE))
    totals = base.groupBy(F.col("conv_id").alias("c"), F.col("run").alias("r")).agg(F.count("*").alias("n"), F.sum("chars").alias("total"))
    earlier = Window.partitionBy("c").orderBy(F.col("r").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("c", "r", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("at0"))
    inside = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    rows = base.withColumn("nth", F.row_number().over(inside) - 1).withColumn("end", F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
    start = F.col("at0") + F.col("end") - F.col("chars")
    trained = F.col("role") == TRAINED
    return rows.select(
        "conv_id", (F.col("n0") + F.col("nth")).alias("seq"), F.concat(lead, escape(F.col("text")), F.lit(CLOSE)).alias("piece"), start.alias("start"),
        F.when(trained, start + F.col("lead")).alias("loss_start"), F.when(trained, start + F.col("lead") + F.col("body")).alias("loss_end"),
    )


def examples(pieces_: DataFrame) -> DataFrame:
    """conv_id, seq, context_end, loss_start and loss_end: one example for each trained turn."""
    return pieces_.where(F.col("loss_start").isNotNull()).select("conv_id", "seq", F.col("start").alias("context_end"), "loss_start", "loss_end")


def example_texts(pieces_: DataFrame, wanted: DataFrame) -> DataFrame:
    """The examples `wanted` (conv_id, seq, loss_start, loss_end) written out: text up to and with the target.

    Only for as many examples as fit: each repeats its whole context.
    """
    parts = wanted.alias("w").join(pieces_.alias("p"), (F.col("w.conv_id").eqNullSafe(F.col("p.conv_id"))) & (F.col("p.seq") <= F.col("w.seq")))
    whole = parts.groupBy("w.conv_id", "w.seq", "w.loss_start", "w.loss_end").agg(F.array_sort(F.collect_list(F.struct("p.seq", "p.piece"))).alias("run"))
    text = F.array_join(F.transform("run", lambda x: x["piece"]), "")
    return whole.select("conv_id", "seq", "loss_start", "loss_end", F.substring(text, F.lit(1), F.col("loss_end").cast("int")).alias("text"))


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BREAK) + "(.*)" + re.escape(CLOSE), re.S)


def read_back(stored: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The digests of each conversation, parsed from formatted rows sorted as they were made.

    The loss digests are those of the examples `wanted`, of all examples if it is not given. An
    example's context must be all pieces before its own.
    """
    kind = stored.schema["conv_id"].dataType.simpleString()
    # An example is a row before its piece, so that pieces move once and nothing is joined.
    made = (examples(stored) if wanted is None else wanted).select("conv_id", "seq", F.lit(None).cast("string").alias("piece"), F.col("context_end").alias("start"), "loss_start", "loss_end")
    null = F.lit(None).cast("long")
    rows = stored.select("conv_id", "seq", "piece", "start", null.alias("loss_start"), null.alias("loss_end")).unionByName(made)
    run_ = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", F.col("piece").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, example = object(), None, None

        def close(state: list, out: list) -> None:
            conv, n, turns, chars, loss, total = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def table(rows: list, kind: pa.DataType) -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

        conv_type = None
        for batch in batches:
            conv_type, out = batch.column(0).type, []
            for conv, piece, start, a, b in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)], strict=True):
                if piece is None:
                    example = (start, a, b)
                    continue
                (context, a, b), example = example or (start, None, None), None
                if state is None or conv != now:
                    if state is not None:
                        close(state, out)
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if a is not None and not context == start == state[5]:
                    raise ValueError(f"the context of an example of conversation {conv} ends at {context}, its turns at {state[5]}")
                role, text = _TURN.fullmatch(piece).groups()
                state[1] += 1
                state[2].update(f"{unescape_role(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
                if a is not None:  # the mask, not the role, says what is trained
                    reply = unescape(piece[a - start : b - start])
                    state[3] += len(reply)
                    state[4].update(reply.encode("utf-8", "surrogatepass"))
                state[5] += len(piece)
            yield table(out, conv_type)
        if state is not None:
            out = []
            close(state, out)
            yield table(out, conv_type)

    return run_.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
