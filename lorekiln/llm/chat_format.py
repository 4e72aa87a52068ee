"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines, then turns are rendered.

The states are the roles. A part shows features: the speaker marker at its head if it has one, its place in the turn
and in the conversation, its length, and whether it asks. Transitions and emissions are smoothed counts over the rows that
name a role; Viterbi finds each conversation's likeliest roles. A role that a row names, or a part's chat-template tag, is
observed, so all paths pass through it; the other parts' roles are inferred from these and from their features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekiln.llm import textvec as tv
from lorekiln.llm.store import cut

ROLES = ("system", "user", "assistant")
#: Names that rows and markers use for the roles.
NAMES = {
    "system": 0, "instruction": 0, "context": 0,
    "user": 1, "human": 1, "prompter": 1, "customer": 1, "question": 1, "q": 1, "you": 1, "inst": 1,
    "assistant": 2, "ai": 2, "bot": 2, "gpt": 2, "model": 2, "agent": 2, "answer": 2, "a": 2, "/inst": 2,
}
#: Tags of chat templates: they begin a part wherever a line begins with one.
TAG = re.compile(
    r"""^[ \t]*(?:
        <\|im_start\|>[ \t]*([A-Za-z]{1,12})[ \t]*$                          # <|im_start|>user
      | <\|(/?[A-Za-z]{1,12})\|>                                            # <|user|>
      | \[(/?[A-Za-z]{1,12})\]                                              # [INST]
    )[ \t]*\n?""",
    re.VERBOSE | re.MULTILINE,
)
#: Names with a colon: prose has them too, so they begin parts only in turns whose first line has a marker.
NAME = re.compile(r"^[ \t]*(?:\#{1,4}[ \t]*|\*\*)?(/?[A-Za-z]{1,12})[ \t]*(?:\*\*[ \t]*:|:[ \t]*\*\*|:)[ \t]*\n?", re.MULTILINE)
CLOSERS = re.compile(r"\s*(?:<\|im_end\|>|<\|end\|>|</s>)\s*$")
SEGMENT = 256  # turn numbers decoded together; longer conversations are joined from segments
UNKNOWN = 3
#: Sizes of the features: marker (or none), place, length, question.
SIZES = (4, 3, 6, 2)
#: Pseudo-counts of a marker's role in each state (one that names the state, any other, none), of first states, of moves: conversations take turns.
MARKS = (20.0, 0.2, 20.0)
FIRST = np.array([2.0, 6.0, 1.0])
MOVES = np.array([[1.0, 8.0, 1.0], [0.5, 1.0, 8.0], [0.5, 8.0, 1.0]])
SURE = -1e6  # log probability of a state that what is observed rules out


def role_of(name: str | None) -> int:
    return NAMES.get(name.strip().lower(), UNKNOWN) if isinstance(name, str) else UNKNOWN


def _marks(pattern: re.Pattern, text: str, tag: bool) -> Iterator[tuple[int, int, int, bool]]:
    for m in pattern.finditer(text):
        role = NAMES.get(m.group(m.lastindex).lower())
        if role is not None:
            yield m.start(), m.end(), role, tag


def parts_of(text: str | None) -> list[tuple[int, bool, str, str]]:
    """A turn's parts, each from a marker to the next: (marked role, whether by a tag, text, text with its marker)."""
    if not isinstance(text, str) or not text:
        return [(UNKNOWN, False, "", "")]
    marks = list(_marks(TAG, text, True)) if "<|" in text or "[" in text else []
    lead = len(text) - len(text.lstrip())
    line = text.rfind("\n", 0, lead) + 1
    opening = NAME.match(text, line) if ":" in text[line : lead + 24] else None
    if (marks and marks[0][0] <= lead) or (opening and opening.group(1).lower() in NAMES):
        marks = sorted([*marks, *_marks(NAME, text, False)])
        marks = [m for m, before in zip(marks, [None, *marks[:-1]], strict=True) if before is None or m[0] >= before[1]]
    if not marks or text[: marks[0][0]].strip():
        marks = [(0, 0, UNKNOWN, False), *marks]
    ends = [m[0] for m in marks[1:]] + [len(text)]
    clean = lambda x: CLOSERS.sub("", x).strip()
    return [(role, tag, clean(text[stop:end]), clean(text[start:end])) for (start, stop, role, tag), end in zip(marks, ends, strict=True)]


class Parts:
    """The parts of whole segments of turns: a row for each, of segments in turn."""

    def __init__(self, pdf: pd.DataFrame, keys: list[str]):
        bounds = tv.group_bounds(pdf, keys)
        named, texts, seg = [role_of(x) for x in pdf["role"]], pdf["text"].to_numpy(), pdf["seg"].to_numpy()
        opens = {int(i) for i in bounds[:-1] if seg[i] <= 0}
        row, part, observed, feats, self.marked, self.text, self.raw = [], [], [], [], [], [], []
        self.first_part = np.zeros(len(pdf) + 1, np.int64)
        for i, text in enumerate(texts):
            self.first_part[i] = len(row)
            for j, (marked, tag, body, raw) in enumerate(parts_of(text)):
                row.append(i)
                part.append(j)
                observed.append(named[i] if j == 0 and named[i] != UNKNOWN else marked if tag else UNKNOWN)
                feats.append((marked, 0 if i in opens and j == 0 else 1 if j == 0 else 2, min(5, len(body).bit_length() // 2), int("?" in body[-3:])))
                self.marked.append(marked)
                self.text.append(body)
                self.raw.append(raw)
        self.first_part[-1] = len(row)
        self.row, self.part, self.observed, self.feats = np.array(row, np.int64), np.array(part, np.int32), np.array(observed), np.array(feats).reshape(-1, len(SIZES))
        self.named = np.array(named, np.int64)[self.row]
        self.bounds = self.first_part[bounds]  # parts of each segment
        self.segments = bounds[:-1]  # first turn of each

    def rendered(self, states: np.ndarray) -> list[str]:
        """A part as its role and text, without a marker that says what the role says; marks of this format inside are escaped."""
        out = []
        for s, marked, text, raw in zip(states.tolist(), self.marked, self.text, self.raw, strict=True):
            body = text if marked == s or marked == UNKNOWN else raw
            out.append(f"<|{ROLES[s]}|>\n{body.replace('<|', '<' + chr(92) + '|')}\n<|end|>\n")
        return out


class Model:
    """Log probabilities of first states, moves and features."""

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        n = len(ROLES)
        first, move = FIRST.copy(), MOVES.copy()
        emit = [np.full((n, s), 5.0) for s in SIZES]
        emit[0] = np.where(np.eye(n, SIZES[0]) > 0, MARKS[0], MARKS[1])
        emit[0][:, UNKNOWN] = MARKS[2]
        for (kind, a, b), c in counts.items():
            if kind == "first":
                first[a] += c
            elif kind == "move":
                move[a, b] += c
            else:
                emit[int(kind)][a, b] += c
        self.first = np.log(first / first.sum())
        self.move = np.log(move / move.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]

    def scores(self, feats: np.ndarray, observed: np.ndarray) -> np.ndarray:
        """Of each part and state; what is observed rules the other states out."""
        out = sum(self.emit[k][:, feats[:, k]] for k in range(len(SIZES))).T
        return out + np.where((observed[:, None] == UNKNOWN) | (observed[:, None] == np.arange(len(ROLES))), 0.0, SURE)


def best_through(model: Model, emit: np.ndarray, first: bool) -> np.ndarray:
    """The max-plus matrix of a segment: the best score from the state before it (row) to the state at its end.

    Of a conversation's first segment all rows are alike: the first state's probability stands for the move.
    """
    total = (np.broadcast_to(model.first, model.move.shape) if first else model.move) + emit[0]
    for e in emit[1:]:
        total = (total[:, :, None] + model.move[None]).max(1) + e
    return total


def viterbi(model: Model, emit: np.ndarray, bounds: np.ndarray, before: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The best states of segments of parts, given each one's state before it and at its end (-1: a conversation's start, free).

    All segments step together, longest first.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, size, before, end = bounds[:-1][order], size[order], before[order], end[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")  # segments of t + 1 parts at least
    back, out = np.zeros((len(emit), len(ROLES)), np.int8), np.zeros(len(emit), np.int64)
    start = np.vstack([model.move, model.first[None]])  # row -1 for conversations that start
    best = np.zeros((0, len(ROLES)))
    last = np.zeros((len(size), len(ROLES)))
    for t, n in enumerate(alive):
        if t == 0:
            best = start[before] + emit[first]
        else:
            step = best[:n, :, None] + model.move
            back[first[:n] + t] = step.argmax(1)
            best = step.max(1) + emit[first[:n] + t]
        last[:n] = best
    state = np.where(end < 0, last.argmax(1), end)
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        out[at] = state[:n]
        state[:n] = back[at, state[:n]]
    return out


def _moves(parts: Parts) -> dict[tuple[str, int, int], int]:
    """Counts of the model from the parts whose role a row names or a marker tells, a segment's parts in order."""
    state = np.where(parts.part == 0, parts.named, parts.feats[:, 0])
    state[(parts.part > 0) & (parts.named == UNKNOWN)] = UNKNOWN
    known, place = state != UNKNOWN, parts.feats[:, 1]
    follows = known.copy()
    follows[parts.bounds[:-1][np.diff(parts.bounds) > 0]] = False
    follows[1:] &= known[:-1]
    found = [("first", state[known & (place == 0)], np.zeros(int((known & (place == 0)).sum()), np.int64))]
    at = np.flatnonzero(follows)
    found.append(("move", state[at - 1], state[at]))
    own = known & (parts.part == 0)
    found.append(("0", state[own], parts.feats[own, 0]))
    found += [(str(k), state[known], parts.feats[known, k]) for k in range(1, len(SIZES))]
    total: dict[tuple[str, int, int], int] = {}
    for kind, a, b in found:
        for pair, n in zip(*np.unique(a * 16 + b, return_counts=True), strict=True):
            total[kind, int(pair) // 16, int(pair) % 16] = int(n)
    return total


KEYS = ["conv_key", "seg"]
ORDER = [*KEYS, "conv_id", "turn", "text", "role"]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in tv.whole_groups(batches, KEYS):
        total = _moves(Parts(pdf, KEYS))
        if total:
            yield pd.DataFrame([(*k, c) for k, c in total.items()], columns=["kind", "a", "b", "c"])


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, role, named_role, rendered for each part of each row of turns(conv_id, turn, role, text).

    A part begins where a line has a tag ("<|im_start|>system", "<|user|>", "[INST]") and, in turns whose first line has a marker, where one has a
    speaker's name and a colon ("User:", "### Assistant:"); a turn without these is one part. role is the row's, for its first part, if
    it names one, that of the tag if there is one, else the one that Viterbi finds. rendered is the part as <|role|>, its text, <|end|>;
    a marker that names the role is left out, any other text stays, and "<|" in it becomes "<\\|".

    Turns are decoded in their order, ties by text; null turns come first, null conv_ids are one conversation. Null or
    unknown roles are found from the rest; null and empty texts are parts without text, very long ones are as others; repeated rows are turns that
    repeat. A conversation opens with its first turn if that is below SEGMENT. Conversations
    are decoded in segments of SEGMENT turn numbers: the best scores through each segment are small matrices, one pass over a conversation's
    matrices gives the roles at the seams, and the segments are then decoded apart, with the same result as whole. Moves over a seam
    are not counted by the model. Other columns are ignored; an empty table gives an empty result.
    """
    types = dict(turns.dtypes)
    tv.bound_batches(turns.sparkSession)
    src = turns.select("conv_id", "turn", "role", "text").withColumns(
        {"conv_key": F.xxhash64("conv_id", F.col("conv_id").isNull()), "seg": F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-1)).cast("long")}
    )
    dealt = lambda df: df.repartition(*KEYS).sortWithinPartitions(*ORDER)
    counts = dealt(src).mapInPandas(_count, "kind string, a int, b int, c long").groupBy("kind", "a", "b").agg(F.sum("c").alias("c")).collect()
    model = Model({(r.kind, r.a, r.b): float(r.c) for r in counts})
    out = f"conv_id {types['conv_id']}, turn {types['turn']}, part int, role string, named_role string, rendered string"

    def through(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tv.whole_groups(batches, KEYS):
            parts = Parts(pdf, KEYS)
            emit = model.scores(parts.feats, parts.observed)
            begins = (pdf["seg"] == pdf["first_seg"]).to_numpy()[parts.segments]
            mats = [best_through(model, emit[a:b], bool(first)).ravel() for a, b, first in zip(parts.bounds[:-1], parts.bounds[1:], begins, strict=True)]
            yield pd.DataFrame({"conv_key": pdf["conv_key"].to_numpy()[parts.segments], "seg": pdf["seg"].to_numpy()[parts.segments], "m": mats})

    def seams(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        mats = np.stack(pdf["m"].to_numpy()).reshape(-1, len(ROLES), len(ROLES))
        best, back = mats[0][0], []
        for m in mats[1:]:
            step = best[:, None] + m
            back.append(step.argmax(0))
            best = step.max(0)
        ends = [int(best.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        return pd.DataFrame({"conv_key": pdf["conv_key"], "seg": pdf["seg"], "before": [-1, *ends[:-1]], "end": ends})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in tv.whole_groups(batches, KEYS):
            parts = Parts(pdf, KEYS)
            free = np.full(len(parts.segments), -1, np.int64)
            before, end = (pdf[c].to_numpy(np.int64)[parts.segments] if c in pdf else free for c in ("before", "end"))
            states = viterbi(model, model.scores(parts.feats, parts.observed), parts.bounds, before, end)
            yield pd.DataFrame(
                {
                    "conv_id": pdf["conv_id"].to_numpy()[parts.row],
                    "turn": pdf["turn"].to_numpy()[parts.row],
                    "part": parts.part,
                    "role": np.array(ROLES, object)[states],
                    "named_role": pdf["role"].to_numpy()[parts.row],
                    "rendered": parts.rendered(states),
                }
            )

    spans = src.groupBy("conv_key").agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg"))
    several = cut(spans.where("first_seg < last_seg").select("conv_key", "first_seg"))
    if several.isEmpty():
        return dealt(src).mapInPandas(decode, out)
    short, long = src.join(several, "conv_key", "left_anti"), src.join(several, "conv_key")
    joints = (
        dealt(long)
        .mapInPandas(through, "conv_key long, seg long, m array<double>")
        .groupBy("conv_key")
        .applyInPandas(seams, "conv_key long, seg long, before int, end int")
    )
    apart = dealt(long.drop("first_seg").join(joints, KEYS)).mapInPandas(decode, out)
    return dealt(short).mapInPandas(decode, out).unionByName(apart)
