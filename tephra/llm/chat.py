"""Transcripts to turns: a hidden Markov model over the lines of a transcript, decoded by Viterbi.

A state is a role with a phase, the first line of a turn or a later one. A line is observed through six features: its
speaker marker (a word for a role, the first, second or another proper name, or none), whether the line before is
blank, whether it is blank itself, its length in words, whether it ends in a question mark, and, on the first line
after a blank one or with a marker, how many words follow up to the next such line. Start, transition and emission
probabilities are counts from transcripts whose roles are known, with 1/2 added; tasks sum them, so only the sums reach
the driver, and every known transcript counts.

Decoding works on whole transcripts, one row at a time; rows are independent, so no line is ever shuffled. White space
at a transcript's end belongs to no turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.session import tidy

ROLES = ("system", "user", "assistant")
#: Words that name a role in a marker (fixed values).
WORDS = {
    "system": ("system", "instructions", "context", "sys"),
    "user": ("user", "human", "question", "q", "customer", "prompter", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "response", "gpt"),
}
CLASS_OF = {word: 1 + i for i, role in enumerate(ROLES) for word in WORDS[role]}
NAME = r"(?P<{0}>[^\W\d_][\w.'-]{{0,20}}(?: [\w.'-]{{1,20}}){{0,2}})"
MARKER = re.compile(
    r"\s*(?:<\|?" + NAME.format("a") + r"\|?>:?|\[" + NAME.format("b") + r"\]:?|#{1,6} *" + NAME.format("c") + r"(?: *:|(?= *$))|\*\*" + NAME.format("d") + r"(?::\*\*|\*\*:?)|" + NAME.format("e") + r":(?=\s|$))[ \t]*"
)
SIZES = (7, 2, 2, 5, 2, 8)
#: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
STARTS, INSIDE = range(0, 6, 2), range(1, 6, 2)


def split_marker(line: str) -> tuple[str | None, str]:
    """(speaker in lower case, rest of the line); (None, line) if no marker stands first."""
    found = MARKER.match(line)
    return (found[found.lastgroup].lower(), line[found.end() :]) if found else (None, line)


def features(lines: Sequence[str]) -> np.ndarray:
    """An observation of six small integers for each line."""
    out, names, blank = np.zeros((len(lines), 6), np.int64), {}, True
    heads, words = [], np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        name, rest = split_marker(line)
        if name is not None:
            out[i, 0] = CLASS_OF.get(name) or min(6, 4 + names.setdefault(name, len(names)))
        if blank or name is not None:
            heads.append(i)
        out[i, 1], blank = blank, not line.strip()
        out[i, 2] = blank
        words[i] = len(rest.split())
        out[i, 4] = rest.rstrip().endswith("?")
    out[:, 3] = np.searchsorted((1, 6, 16, 41), words, "right")
    if heads:
        out[heads, 5] = 1 + np.searchsorted((8, 31, 61, 91, 141, 201), np.add.reduceat(words, heads), "right")
    return out


@dataclass(frozen=True)
class Model:
    start: np.ndarray  # (6,)
    step: np.ndarray  # (6, 6)
    emit: tuple[np.ndarray, ...]  # six of (6, size), all logarithms

    def scores(self, observed: np.ndarray) -> np.ndarray:
        return sum(table[:, observed[:, i]] for i, table in enumerate(self.emit)).T


def count(examples: Iterable[tuple[Sequence[str], Sequence[int]]]) -> list[np.ndarray]:
    """How often (lines, states) of known transcripts start, step and emit."""
    tables = [np.zeros(6), np.zeros((6, 6)), *(np.zeros((6, n)) for n in SIZES)]
    for lines, states in examples:
        if not len(lines):
            continue
        observed, states = features(lines), np.asarray(states)
        tables[0][states[0]] += 1
        np.add.at(tables[1], (states[:-1], states[1:]), 1)
        for i, table in enumerate(tables[2:]):
            np.add.at(table, (states, observed[:, i]), 1)
    return tables


def model_of(tables: Sequence[np.ndarray]) -> Model:
    """The model of such counts; no example gives even chances."""
    start, step, *emit = [t + 0.5 for t in tables]
    start[list(INSIDE)] = 1e-9
    for a in range(6):  # a turn goes on in its own role
        for b in INSIDE:
            if a // 2 != b // 2:
                step[a, b] = 1e-9
    logs = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(logs(start), logs(step), tuple(logs(e) for e in emit))


def fit(examples: Iterable[tuple[Sequence[str], Sequence[int]]]) -> Model:
    """A model of known transcripts, given as (lines, states)."""
    return model_of(count(examples))


def viterbi(model: Model, observed: np.ndarray) -> tuple[list[int], float]:
    """The likeliest states and their log probability; of equal paths the one with lower states from the end."""
    if not len(observed):
        return [], 0.0
    scores = model.scores(observed)
    best, back = model.start + scores[0], np.zeros(scores.shape, np.int64)
    for i in range(1, len(scores)):
        paths = best[:, None] + model.step
        back[i] = paths.argmax(0)
        best = paths.max(0) + scores[i]
    at = int(best.argmax())
    states = [at]
    for i in range(len(scores) - 1, 0, -1):
        at = int(back[i, at])
        states.append(at)
    return states[::-1], float(best.max())


def lines_of(text: str | None) -> list[str]:
    """The lines of a text without the white space at its end; none of null and blank texts."""
    text = (text or "").rstrip(BLANKS)
    return text.split("\n") if text else []


def turns_of(lines: Sequence[str], states: Sequence[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn: markers of first lines and blank lines at a turn's edges go."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [split_marker(line)[1]]))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(body).strip("\n")) for role, body in turns]


def render(turns: Sequence[tuple[str, str]]) -> str:
    """The canonical form. ``<|`` inside a text is written ``< |``, so a text cannot pose as a marker."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '< |')}\n<|end|>\n" for role, text in turns)


def states_of(turns: Sequence[tuple[str, Sequence[str]]]) -> tuple[list[str], list[int]]:
    """Lines and states of turns given as (role, lines as they stand in the transcript)."""
    lines, states = [], []
    for role, body in turns:
        at = 2 * ROLES.index(role)
        lines += body
        states += [at] + [at + 1] * (len(body) - 1)
    return lines, states


#: How a turn may stand in a raw transcript: before its text, and after it.
STYLES = (("{Role}: ", "\n"), ("### {Word}:\n", "\n\n"), ("<|{role}|>\n", "\n"), ("**{Word}:** ", "\n\n"), ("{Name}: ", "\n"), ("", "\n\n"))
MARKS = {
    "Role": {"system": "System", "user": "User", "assistant": "Assistant"},
    "role": {"system": "system", "user": "user", "assistant": "assistant"},
    "Word": {"system": "Instructions", "user": "Human", "assistant": "AI"},
    "Name": {"system": "Context", "user": "Kim", "assistant": "Robin"},
}


def style_of(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(len(STYLES))).cast("int")


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, style, true_turns, transcript): turns of (conv_id, turn, role, text) as raw text, in the style their key hashes to.

    Null texts count as empty; roles not in ``ROLES`` count as user; equal turn numbers are ordered by role and text,
    repeated rows are repeated turns. Rows of a null conv_id are one conversation. Transcripts end in no white space.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.lit("user"))
    kept = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("true_turns")).withColumn("style", style_of(F.col("conv_id")))

    def marked(t: Column) -> Column:
        out = F.lit("")
        for i, (before, after) in enumerate(STYLES):
            found = re.search(r"\{(\w+)\}", before)
            mark = F.lit(before)
            if found:
                name = F.lit("")
                for r in ROLES:
                    name = F.when(t["role"] == r, F.lit(before.replace(found[0], MARKS[found[1]][r]))).otherwise(name)
                mark = name
            out = F.when(F.col("style") == i, F.concat(mark, t["text"], F.lit(after))).otherwise(out)
        return out

    return grouped.withColumn("transcript", F.regexp_replace(F.array_join(F.transform("true_turns", marked), ""), r"[ \t\n\x0B\f\r]+$", ""))


def example(style: int, turns: Sequence) -> tuple[list[str], list[int]]:
    """A known transcript as (lines, states), cut at its end as ``transcripts`` and ``lines_of`` do."""
    before, after = STYLES[style]
    parts = []
    for t in turns:
        found = re.search(r"\{(\w+)\}", before)
        mark = before.replace(found[0], MARKS[found[1]][t["role"]]) if found else before
        parts.append((t["role"], (mark + t["text"] + after).removesuffix("\n").split("\n")))
    lines, states = states_of(parts)
    kept = lines_of("\n".join(lines))
    return kept, states[: len(kept)]


def fit_on(raw: DataFrame) -> Model:
    """A model of all known transcripts (style, true_turns) of ``raw``; an empty table gives even chances."""
    ends = np.cumsum([0, 6, 36, *(6 * n for n in SIZES)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(ends[-1])
        for batch in batches:
            total += np.concatenate([t.ravel() for t in count(example(r.style, r.true_turns) for r in batch.itertuples())])
        yield pd.DataFrame({"at": np.arange(len(total)), "n": total})

    found = raw.select("style", "true_turns").mapInPandas(sums, "at int, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(ends[-1])
    total[found["at"].to_numpy(int)] = found["n"]
    shapes = [(6,), (6, 6), *((6, n) for n in SIZES)]
    return model_of([total[a:b].reshape(shape) for a, b, shape in zip(ends, ends[1:], shapes, strict=False)])


def parse(raw: DataFrame, model: Model, *, id_col: str = "conv_id", text_col: str = "transcript", keep: Sequence[str] = ()) -> DataFrame:
    """A row per row: id, turns (role, text), n_turns, rendered, log_prob, and the columns ``keep``; other columns are ignored.

    Null, empty and blank texts have no turns and render as ''. A text of any length is decoded whole. Equal texts
    decode alike; repeated rows stay. An empty table gives no rows.
    """
    kinds = dict(raw.dtypes)

    @tidy
    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch[text_col]:
                lines = lines_of(text)
                states, log_prob = viterbi(model, features(lines))
                turns = turns_of(lines, states)
                out.append(([{"role": r, "text": t} for r, t in turns], len(turns), render(turns), log_prob))
            found = pd.DataFrame(out, columns=["turns", "n_turns", "rendered", "log_prob"])
            yield pd.concat([batch[[id_col, *keep]].reset_index(drop=True), found], axis=1)

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (id_col, *keep)), "turns array<struct<role:string,text:string>>, n_turns int, rendered string, log_prob double"])
    return raw.select(id_col, *keep, text_col).mapInPandas(decode, schema)
