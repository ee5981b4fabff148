"""Chat formatting: a hidden Markov model recovers turns and roles of a transcript, then turns are rendered.

The hidden state of a line is the role that speaks and whether the line begins a turn. Its marks
(speaker marker, length, question, list or code) are independent given the state, and states follow
each other as a Markov chain; all probabilities are smoothed counts of labelled turns. Turns that
come apart already are the same with one state a role and a turn for a line. Viterbi works in
blocks, so that a conversation of any length is never in one task: a block's lines make one matrix
of best scores between the state before it and its last state, blocks of blocks do the same until a
conversation is one block, and on the way back each block's best path is found between the states
at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, source_columns, table
from .lang_id import held_out_flag
from .ranks import positions

#: Names that speaker markers use, by the role they stand for.
MARKERS = {
    "user": ("user", "human", "customer", "client", "student", "question", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "teacher", "answer", "a"),
    "system": ("system", "instruction", "instructions", "context", "prompt"),
}
#: Values of each mark: marker, length, lines, question, list or code.
SIZES = (len(MARKERS) + 2, 16, 8, 2, 2)
BLOCK = 512
#: Part of the marked turns whose speaker the model of lines takes to have a name that isn't listed.
UNLISTED = 0.1
#: Such a name: a letter, then up to 30 letters, digits, dots, dashes or underlines.
ANY_NAME = r"\p{L}[\p{L}\p{N}_.-]{0,30}"


def marker_pattern(names: tuple[str, ...]) -> str:
    """A marker at the start: ``Name:``, ``[Name]``, ``**Name:**``, ``### Name`` on a line of its own or ``<|im_start|>name``."""
    name = f"(?:{'|'.join(names)})"
    return (
        rf"(?i)^\s*(?:<\|(?:im_start\|>)?{name}(?:\|>)?\s|[\[(]{name}[\])]\s*:?\s*"
        rf"|#{{1,4}}\s*{name}\s*(?:[:>]|\n|$)\s*|(?:\*\*)?{name}\s*[:>](?:\*\*)?\s*)"
    )


def markers() -> list[tuple[str, str]]:
    return [(role, marker_pattern(names)) for role, names in MARKERS.items()]


def marks(text: Column) -> list[Column]:
    """The marks of a turn as small integers; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    kind = F.when(text.rlike(marker_pattern((ANY_NAME,))), len(MARKERS) + 1).otherwise(0)
    for i, (_, pattern) in reversed(list(enumerate(markers(), 1))):
        kind = F.when(text.rlike(pattern), i).otherwise(kind)
    size = F.least(F.floor(F.log2(F.length(text) + F.lit(1.0))).cast("int"), F.lit(SIZES[1] - 1))
    lines = F.least(F.size(F.split(text, "\n")), F.lit(SIZES[2])) - 1
    asks = F.rtrim(text).endswith("?").cast("int")
    lists = text.rlike(r"(?m)^\s*(?:[-*•]\s|\d+[.)]\s|```)").cast("int")
    return [kind.cast("int"), size, lines, asks, lists]


def content(text: Column, role: Column) -> Column:
    """The text less its end tag and one speaker marker at its start, if that marker stands for ``role``."""
    text = F.coalesce(text, F.lit(""))
    out = text
    for name, pattern in markers():
        out = F.when((role == name) & text.rlike(pattern), F.regexp_replace(text, pattern, "")).otherwise(out)
    return F.regexp_replace(out, r"<\|(?:im_end|end)\|>\s*$", "")


def rendered(text: Column, role: Column) -> Column:
    """The canonical turn."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content(text, role), F.lit("\n<|end|>\n"))


@dataclass(frozen=True)
class Hmm:
    roles: tuple[str, ...]
    start: np.ndarray  # roles
    step: np.ndarray  # role before x role
    emit: tuple[np.ndarray, ...]  # for each mark: roles x values


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(x / x.sum(-1, keepdims=True)) if len(x) else x


def _firsts_and_moves(known: DataFrame, first: str, last: str, place: dict[str, int], smooth: float) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the states that conversations start with and of pairs of states of turns that follow each other.

    The turn before is that with the number before, so that no conversation is brought together; a turn
    without one counts as a first turn if its number is the smallest there can be (0 or 1).
    """
    s = len(place)
    start, step = np.full(s, smooth), np.full((s, s), smooth)
    now = known.select("conv_id", "turn", F.col(first).alias("state"))
    before = known.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col(last).alias("before")).where("turn IS NOT NULL")
    before = before.groupBy("conv_id", "turn").agg(F.min("before").alias("before"))
    both = now.join(before, ["conv_id", "turn"], "left")
    for r in both.where("before IS NOT NULL OR turn IN (0, 1)").groupBy("before", "state").count().collect():
        if r["before"] is None:
            start[place[r["state"]]] += r["count"]
        else:
            step[place[r["before"]], place[r["state"]]] += r["count"]
    return start, step


def _emissions(rows: DataFrame, state: str, place: dict[str, int], smooth: float) -> list[np.ndarray]:
    """Counts of the values of each mark in each state."""
    emit = [np.full((len(place), n), smooth) for n in SIZES]
    for i, role in enumerate(MARKERS, 1):  # a marker speaks for its role before any is counted
        if role in place:
            emit[0][place[role], i] += 20
    counts = rows.select(F.col(state).alias("state"), *[m.alias(f"m{j}") for j, m in enumerate(marks(F.col("text")))])
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"m{j}").alias("v")) for j in range(len(SIZES))])).alias("p")
    for r in counts.select("state", pairs).groupBy("state", "p.j", "p.v").count().collect():
        emit[r["j"]][place[r["state"]], r["v"]] += r["count"]
    return emit


def train(turns: DataFrame, smooth: float = 0.5) -> Hmm:
    """A model of turns (``conv_id``, ``turn``, ``role``, ``text``) that come apart; rows without a role are left out.

    The driver gets counts of roles, pairs of roles and marks only.
    """
    known = turns.where(F.col("role").isNotNull()).select("conv_id", F.col("turn").cast("decimal(20,0)").alias("turn"), "role", "text")
    roles = tuple(sorted(r[0] for r in known.select("role").distinct().collect()))
    place = {r: i for i, r in enumerate(roles)}
    start, step = _firsts_and_moves(known, "role", "role", place, smooth)
    return Hmm(roles, _log(start), _log(step), tuple(map(_log, _emissions(known, "role", place, smooth))))


#: What a state's name ends with if the line goes on with a turn.
INSIDE = "+"


def train_lines(turns: DataFrame, smooth: float = 0.5) -> Hmm:
    """A model of the lines of turns (``conv_id``, ``turn``, ``role``, ``text`` with its speaker marker): for each role a
    state that begins a turn and one that goes on. Moves that can't be have next to no chance. Names that aren't listed
    may begin a turn of any role with the chance ``UNLISTED`` gives them; they stay in its text, as they may be part of it."""
    known = turns.where(F.col("role").isNotNull()).select("conv_id", F.col("turn").cast("decimal(20,0)").alias("turn"), "role", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    names = sorted(r[0] for r in known.select("role").distinct().collect())
    roles = (*names, *(r + INSIDE for r in names))
    place, n = {r: i for i, r in enumerate(roles)}, len(names)
    known = known.withColumn("last", F.when(F.size("lines") > 1, F.concat("role", F.lit(INSIDE))).otherwise(F.col("role")))
    start, step = _firsts_and_moves(known, "role", "last", place, smooth)
    start[n:] = 1e-9
    step[:, n:] = 1e-9
    within = known.groupBy("role").agg(F.sum((F.size("lines") > 1).cast("long")).alias("once"), F.sum(F.greatest(F.size("lines") - 2, F.lit(0))).alias("more"))
    for r in within.collect():
        at = place[r["role"]]
        step[at, at + n] = smooth + r["once"]
        step[at + n, at + n] = smooth + r["more"]
    each = known.select("role", F.posexplode("lines").alias("i", "text"))
    each = each.withColumn("state", F.when(F.col("i") == 0, F.col("role")).otherwise(F.concat("role", F.lit(INSIDE))))
    emit = _emissions(each, "state", place, smooth)
    named = slice(1, len(MARKERS) + 1)
    emit[0][:n, -1] += UNLISTED * emit[0][:n, named].sum(1)  # the last value: a name that isn't listed
    return Hmm(roles, _log(start), _log(step), tuple(map(_log, emit)))


def _max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def _groups(batches: Iterator[pd.DataFrame], extra: tuple[str, ...] = ()) -> Iterator[tuple]:
    """Runs of equal ``conv`` and ``block`` in sorted batches, each whole: conv, block, array of ``k``, list of ``m``, first of each ``extra``."""
    held = None
    for pdf in batches:
        conv, block = pdf["conv"].tolist(), pdf["block"].tolist()
        ks, ms, more = pdf["k"].tolist(), pdf["m"].tolist(), [pdf[c].tolist() for c in extra]
        conv = [None if c != c else c for c in conv]
        for i, key in enumerate(zip(conv, block)):
            if held is None or held[0] != key:
                if held is not None:
                    yield (*held[0], *held[1:])
                held = (key, [], [], [c[i] for c in more])
            held[1].append(ks[i])
            held[2].append(ms[i])
    if held is not None:
        yield (*held[0], *held[1:])


def viterbi(positions: DataFrame, states: int, block: int = BLOCK, base: np.ndarray | None = None) -> DataFrame:
    """The best path. ``positions``: ``conv``, ``k`` (order, not negative) and ``m``, a flat matrix with a row for each
    state before and one for none; with ``base``, such a matrix, ``m`` has only what each state adds to it.
    Returns ``conv``, ``k``, ``state``. Ties go to the lower state."""
    shape = (states + 1, states)

    def matrix(m) -> np.ndarray:
        m = np.asarray(m, float)
        return base + m if base is not None and m.size == states else m.reshape(shape)

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for conv, number, _, ms, _ in _groups(batches):
            best = matrix(ms[0])
            for m in ms[1:]:
                best = _max_plus(best, matrix(m)[:states])
            out.append((conv, number, best.ravel()))
            if len(out) == 5000:
                yield pd.DataFrame(out, columns=["conv", "k", "m"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "k", "m"])

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for conv, _, ks, ms, (before, state) in _groups(batches, ("before", "state")):
            best, back = np.full(states + 1, -np.inf), []
            best[int(before)] = 0.0
            for m in ms:
                scores = best[:, None] + matrix(m)[: len(best)]
                back.append(scores.argmax(0))
                best = scores.max(0)
            path = [int(state)]
            for b in reversed(back[1:]):
                path.append(int(b[path[-1]]))
            path.reverse()
            out += zip([conv] * len(ks), ks, [int(before), *path[:-1]], path)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["conv", "k", "before", "state"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "k", "before", "state"])

    # conversations travel as text: pandas would round large ids beside nulls
    levels = [positions.withColumn("conv", F.col("conv").cast("string"))]
    convs = positions.select("conv").distinct().count()
    while True:
        rows = levels[-1].withColumn("block", F.floor(F.col("k") / block).cast("long"))
        whole = rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "k")
        levels.append(materialize(whole.mapInPandas(up, "conv string, k long, m array<double>"), "viterbi-up"))
        if levels[-1].count() <= convs:
            break
    first = F.slice("m", states * states + 1, states)
    found = levels.pop().select(
        "conv", "k", F.lit(states).alias("before"), (F.array_position(first, F.array_max(first)) - 1).cast("int").alias("state")
    )
    while levels:
        rows = levels.pop().withColumn("block", F.floor(F.col("k") / block).cast("long"))
        ends = found.select(F.col("conv").alias("_c"), F.col("k").alias("_b"), "before", "state")
        both = rows.join(ends, [rows["conv"].eqNullSafe(F.col("_c")), rows["block"] == F.col("_b")]).drop("_c", "_b")
        both = both.repartition("conv", "block").sortWithinPartitions("conv", "block", "k")
        found = materialize(both.mapInPandas(down, "conv string, k long, before int, state int"), "viterbi-down")
    return found.select(F.col("conv").cast(positions.schema["conv"].dataType).alias("conv"), "k", "state")


def recover_roles(turns: DataFrame, model: Hmm, block: int = BLOCK) -> DataFrame:
    """``turns`` (``conv_id``, ``turn``, ``text``) with ``role_pred`` and ``rendered``, the canonical turn.

    Rows of one turn number are one turn and get one role. A null turn comes last, a null
    conversation is one of its own, a null text is empty. Without a learned role ``role_pred`` is
    ``unknown``. Columns of the new names are replaced; no rows give no rows.
    """
    source_columns(turns, "conv_id", "turn", "text")
    turns = turns.drop("role_pred", "rendered")
    s = len(model.roles)
    if not s:
        return turns.withColumns({"role_pred": F.lit("unknown"), "rendered": rendered(F.col("text"), F.lit("unknown"))})
    far = 1 << 62
    order = F.coalesce(F.least(F.greatest(F.col("turn").cast("long"), F.lit(-far)), F.lit(far - 2)) + F.lit(far), F.lit((1 << 63) - 1))
    each = turns.select(F.col("conv_id").alias("conv"), order.alias("k"), *emissions(F.col("text"), model))
    each = each.groupBy("conv", "k").agg(*[F.sum(f"e{r}").alias(f"e{r}") for r in range(s)])
    each = each.select("conv", "k", F.array(*[f"e{r}" for r in range(s)]).alias("m"))
    path = viterbi(materialize(each, "chat-turns"), s, block, np.vstack([model.step, model.start]))
    path = path.select("conv", "k", F.get(F.array(*map(F.lit, model.roles)), F.col("state")).alias("role_pred"))
    rows = turns.select(F.struct(*[F.col(f"`{c}`") for c in turns.columns]).alias("row"), order.alias("at"))
    named = rows.join(path, [F.col("row.conv_id").eqNullSafe(F.col("conv")), F.col("at") == F.col("k")])
    return named.select("row.*", "role_pred", rendered(F.col("row.text"), F.col("role_pred")).alias("rendered"))


def emissions(text: Column, model: Hmm) -> list[Column]:
    """``e0``...: the log chance of the marks of a text in each state."""
    where = marks(text)
    made = [
        sum((F.get(F.array(*[F.lit(float(v)) for v in table_[r]]), m) for table_, m in zip(model.emit, where)), F.lit(0.0))
        for r in range(len(model.roles))
    ]
    return [e.alias(f"e{r}") for r, e in enumerate(made)]


def parse_transcripts(transcripts: DataFrame, model: Hmm, block: int = BLOCK) -> DataFrame:
    """``conv_id``, ``turn`` (from 0), ``role_pred``, ``text`` and ``rendered`` of the turns of transcripts (``conv_id``, ``text``).

    A null text is an empty one and makes one turn with an empty text. Rows with equal ids are one
    transcript, whose lines of one number stand together. See ``parse_lines``.
    """
    source_columns(transcripts, "conv_id", "text")
    lines = transcripts.select("conv_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    return parse_lines(lines, model, block)


def parse_lines(lines: DataFrame, model: Hmm, block: int = BLOCK) -> DataFrame:
    """The same for lines (``conv_id``, ``k``: their order, not negative, ``text``).

    ``model`` comes from ``train_lines``. The best path through the lines tells where turns begin
    and who speaks. Equal lines of one number count once. A null id is one of its own. Without a learned role each line is a
    turn of ``unknown``. Other columns are left out; no rows give no rows.
    """
    s, n = len(model.roles), len(model.roles) // 2
    if not s:
        said = lines.select("conv_id", F.col("k").cast("long").alias("turn"), F.lit("unknown").alias("role_pred"), "text")
        return said.withColumn("rendered", rendered(F.col("text"), F.lit("unknown")))
    lines = materialize(lines.select(F.col("conv_id").alias("conv"), F.col("k").cast("long").alias("k"), F.coalesce("text", F.lit("")).alias("text")).distinct(), "chat-lines")
    each = lines.select("conv", "k", *emissions(F.col("text"), model)).groupBy("conv", "k").agg(*[F.sum(f"e{r}").alias(f"e{r}") for r in range(s)])
    path = viterbi(materialize(each.select("conv", "k", F.array(*[f"e{r}" for r in range(s)]).alias("m")), "chat-marks"), s, block, np.vstack([model.step, model.start]))
    path = path.withColumns({"part": F.floor(F.col("k") / block).cast("long"), "one": (F.col("state") < n).cast("long")})
    path = materialize(path, "chat-path")
    # turns are counted by blocks first, so that no conversation is summed up in one task
    sums = path.groupBy("conv", "part").agg(F.sum("one").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    inside = F.sum("one").over(Window.partitionBy("conv", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    named = path.select("conv", "k", "part", "state", inside.alias("nth")).join(sums, [F.col("conv").eqNullSafe(F.col("c")), F.col("part") == F.col("p")])
    role = F.get(F.array(*map(F.lit, model.roles[:n])), F.col("state") % n).alias("role_pred")
    named = named.select(F.col("conv").alias("c"), F.col("k").alias("at"), (F.col("ahead") + F.col("nth") - 1).alias("turn"), role)
    said = lines.join(named, [F.col("conv").eqNullSafe(F.col("c")), F.col("k") == F.col("at")])
    whole = said.groupBy("conv", "turn").agg(F.max("role_pred").alias("role_pred"), F.sort_array(F.collect_list(F.struct("k", "text"))).alias("ls"))
    text = F.array_join(F.transform("ls", lambda x: x["text"]), "\n")
    out = whole.select(F.col("conv").alias("conv_id"), "turn", "role_pred", text.alias("text"))
    return out.withColumn("rendered", rendered(F.col("text"), F.col("role_pred")))


#: How the query's transcripts mark speakers, by the id of a conversation; ``{}`` is the name.
STYLES = ("{}: ", "[{}] ", "**{}:** ", "### {}\n")
NAMES = {"user": ("User", "Human", "Customer"), "assistant": ("Assistant", "Bot", "Agent"), "system": ("System", "Instructions", "Context")}


def as_transcript(turns: DataFrame) -> DataFrame:
    """``turns`` whose ``text`` has a speaker marker in front, of a style and a name chosen by the conversation's id. Any
    other role stands as a name of its own; turns without a role have no marker."""
    of = lambda k: F.pmod(F.xxhash64(F.lit(k), "conv_id"), F.lit(3)).cast("int")
    name = F.initcap("role")
    for role, names in NAMES.items():
        name = F.when(F.col("role") == role, F.get(F.array(*map(F.lit, names)), of(1))).otherwise(name)
    style = F.get(F.array(*map(F.lit, STYLES)), F.pmod(F.xxhash64(F.lit(2), "conv_id"), F.lit(len(STYLES))).cast("int"))
    mark = F.coalesce(F.replace(style, F.lit("{}"), name), F.lit(""))
    return turns.withColumn("text", F.concat(mark, F.coalesce("text", F.lit(""))))


def lines_of(turns: DataFrame) -> DataFrame:
    """The lines of transcripts that hold ``turns`` one after the other: ``conv_id``, ``k`` (0, 1, 2 ... in each), ``text``.

    Turns stand in the order of their numbers, whatever these are, null last; rows of one turn that
    differ follow each other by text, equal ones count once. Rows and lines are numbered by
    distributed sorts, so that no conversation or turn is brought together.
    """
    rows = turns.select("conv_id", "turn", "text").distinct()
    rows = positions(rows, F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("text"), name="chat-rows").withColumnRenamed("position", "nth")
    each = rows.select("conv_id", "nth", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    each = positions(each, F.col("nth"), F.col("i"), name="chat-places")
    first = each.groupBy(F.col("conv_id").alias("c")).agg(F.min("position").alias("first"))
    return each.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", (F.col("position") - F.col("first")).alias("k"), "text")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation, recovered from its transcript by the model of three conversations in four.

    A transcript holds all turns one after the other behind speaker markers; where turns begin and
    who speaks is found by the model alone.
    """
    marked = as_transcript(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    held = held_out_flag(F.col("conv_id"), 4, 2)
    found = parse_lines(lines_of(marked), train_lines(marked.where(~held)))
    return found.select("conv_id", "turn", held.alias("held_out"), "role_pred", "rendered")
