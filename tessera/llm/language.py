"""Language by cross-parsing entropy.

A suffix automaton holds the labelled text of each language. A document is parsed against it from left to
right into the longest phrases that the automaton knows (a byte that the language lacks is a phrase of its
own); the fewer phrases are needed, normalised by the logarithm of the training text's length, the closer the
language. The language with the fewest wins (ties: the first by name).

A text is one parse from its first byte to its last. Its stretches of ``LANE`` bytes take their steps
together in numpy, at first each from the root; then every stretch whose true state at the start, where the
one before it ended, is another one is parsed again until both parses are in the same state, from where on
they agree. This is repeated until no start changes, so the phrases are those of the whole text.

Training takes whole documents: outside the held-out fold and with a language, picked by a hash of the id
among those of at most ``max_doc_bytes`` bytes, ``max_docs`` per language at most, up to about ``max_bytes``
over all languages (at least ``min_bytes`` for each). Every language is learned: of one that has only longer
documents the shortest is taken, in stretches spread over the whole of it. Language, source and id are never
inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as are all texts if nothing is
labelled; every row is predicted, repeated ones too; an empty table gives none; very long texts are parsed
piece by piece, each going on from the last one's state; a null id is not in the held-out fold and isn't
learned from; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._bytes import PIECE, row_blocks, text_column, trimmed
from tessera.session import ship

LANE = 256
CELLS = 1 << 23


def normalised(raw: np.ndarray) -> np.ndarray:
    """a-z and bytes from 0x80 stay, A-Z are folded, all else is a space."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table[raw]


def single_spaces(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of spaces become one, row by row."""
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[offsets[:-1][offsets[:-1] < len(x)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return x[keep], total[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton that knows all substrings; 0 is the root."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in text:
        now, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[now] = clone
        last = now
    return step


def packed(automata: list[list[dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of all automata in one row: roots, base by state, and (state, next) by base + byte."""
    roots = np.cumsum([0, *map(len, automata)])
    base = np.zeros(int(roots[-1]), np.int32)
    steps: dict[int, list[tuple[int, list[int], list[int]]]] = {}
    for root, automaton in zip(roots.tolist(), automata):
        for i, step in enumerate(automaton):
            if step:
                steps.setdefault(min(len(step), 8), []).append((root + i, list(step), [root + to for to in step.values()]))
    wide = steps.pop(8, [])
    size = 1024 + 257 * len(wide) + 3 * sum(d * len(x) for d, x in steps.items())
    owner, goal, at = np.full(size, -1, np.int32), np.full(size, -1, np.int32), 256
    for state, keys, to in wide:  # one after another
        base[state] = at - min(keys)
        owner[base[state] + np.array(keys)], goal[base[state] + np.array(keys)] = state, to
        at += max(keys) - min(keys) + 1
    rng = np.random.default_rng(5)
    for d in sorted(steps, reverse=True):  # wherever there is room
        state, keys, to = (np.array(x, np.int64) for x in zip(*steps[d]))
        while len(state):
            place = rng.integers(0, size - 256, len(state))
            free = np.flatnonzero((owner[place[:, None] + keys] < 0).all(axis=1))
            cells, mine = place[free, None] + keys[free], state[free, None]
            owner[cells] = mine  # of several for one cell the last stays
            won = (owner[cells] == mine).all(axis=1)
            lost = cells[~won][owner[cells[~won]] == mine[~won] + 0 * cells[~won]]
            owner[lost] = -1
            base[state[free[won]]] = place[free[won]]
            goal[cells[won]] = to[free[won]]
            left = np.setdiff1d(np.arange(len(state)), free[won], assume_unique=True)
            state, keys, to = state[left], keys[left], to[left]
    return roots[:-1].astype(np.int32), base, owner, goal


class Parser:
    """All languages' automata as one table, and the parse of many texts at a time."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.languages = sorted(texts)
        clean = {k: normalised(np.frombuffer(v, np.uint8)).tobytes() for k, v in texts.items()}
        clean = {k: re.sub(rb" +", b" ", v) for k, v in clean.items()}
        self.roots, self.base, self.owner, self.goal = packed([suffix_automaton(clean[k]) for k in self.languages])
        every = np.arange(256)
        to = self.base[self.roots][:, None] + every
        self.first = np.where(self.owner[to] == self.roots[:, None], self.goal[to], self.roots[:, None]).astype(np.int32)
        self.unknown = self.first == self.roots[:, None]
        self.weight = np.array([np.log(max(2, len(clean[k]))) for k in self.languages])

    def _parse(self, code: np.ndarray, offsets: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each row and the states at the rows' ends, by language, from ``state``."""
        size, last = np.diff(offsets), state.copy()
        count = np.zeros((len(self.languages), len(size)), np.int64)
        lanes = -(-size // LANE)
        row = np.repeat(np.arange(len(size)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[row] + nth * LANE
        left = np.minimum(LANE, offsets[row + 1] - start)
        order = np.argsort(-left, kind="stable")  # short stretches leave early
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        start, left, row, nth = start[order], left[order], row[order], nth[order]
        follow = np.flatnonzero(nth > 0)
        ahead = place[order[follow] - 1]  # the stretch before each
        full, ends = np.flatnonzero(size > 0), np.cumsum(lanes) - 1
        group = max(1, CELLS // max(1, len(code)))  # languages at a time, so that memory is bounded
        for g in range(0, len(self.languages), group):
            langs = np.arange(g, min(len(self.languages), g + group))
            roots, first, unknown = self.roots[langs], self.first[langs], self.unknown[langs]
            begin = np.where(nth == 0, state[np.ix_(langs, row)], roots[:, None])
            shape = (int(left.max()) if len(left) else 0, len(langs), len(row))
            states, ended = np.empty(shape, np.int32), np.zeros(shape, np.uint8)
            now, live = begin.copy(), len(row)
            for i in range(shape[0]):
                while live and left[live - 1] <= i:
                    live = int(np.searchsorted(-left, -i, "left"))
                c, s = code[start[:live] + i], now[:, :live]
                at = self.base[s] + c
                to = self.goal[at]
                k, j = np.nonzero(self.owner[at] != s)
                ended[i, k, j] = (s[k, j] != roots[k]) + unknown[k, c[j]].astype(np.uint8)
                to[k, j] = first[k, c[j]]
                now[:, :live] = states[i, :, :live] = to
            while len(follow):
                true = states[left[ahead] - 1, :, ahead].T  # where the one before ended
                k, j = np.nonzero(true != begin[:, follow])
                if not len(k):
                    break
                s, j = true[k, j], follow[j]
                begin[k, j] = s
                for i in range(shape[0]):
                    some = np.flatnonzero(left[j] > i)
                    k, j, s = k[some], j[some], s[some]
                    c = code[start[j] + i]
                    at = self.base[s] + c
                    hit = self.owner[at] == s
                    to = np.where(hit, self.goal[at], first[k, c])
                    ended[i, k, j] = ~hit * ((s != roots[k]) + unknown[k, c].astype(np.uint8))
                    other = np.flatnonzero(states[i, k, j] != to)  # from equal states on both parses agree
                    states[i, k, j] = to
                    k, j, s = k[other], j[other], to[other]
                    if not len(k):
                        break
            total = ended.sum(axis=0, dtype=np.int64)
            count[langs] = [np.bincount(row, weights=x, minlength=len(size)) for x in total]
            end = place[ends[full]]
            last[np.ix_(langs, full)] = states[left[end] - 1, :, end].T
        return count, last

    def phrases(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row, by language and row."""
        x, offsets = single_spaces(normalised(buf), offsets)
        out = np.zeros((len(self.languages), len(offsets) - 1), np.int64)
        for i, j in row_blocks(offsets, PIECE):
            state = np.repeat(self.roots[:, None], j - i, axis=1)
            at = offsets[i : j + 1] - offsets[i]
            part = x[offsets[i] : offsets[j]].astype(np.int64)
            for a in range(0, max(1, len(part)), PIECE):  # a longer row goes on from its last piece
                piece = part[a : a + PIECE]
                count, state = self._parse(piece, np.array([0, len(piece)]) if j - i == 1 else at, state)
                out[:, i:j] += count
            out[:, i:j] += state != self.roots[:, None]  # the last phrase ends with the text
        return out


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out: tuple[int, int], max_bytes: int, min_bytes: int, max_doc_bytes: int, max_docs: int) -> dict[str, bytes]:
    """Whole texts by language within the bounds."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull()).filter(F.crc32(F.col("id").cast("string")) % held_out[0] != held_out[1]).filter(F.length("t") > 0).withColumn("size", F.octet_length("t"))
    fits = F.col("size") <= max_doc_bytes
    counted = rows.groupBy("lang").agg(F.count_if(fits).alias("n"), F.avg(F.when(fits, F.col("size"))).alias("mean"), F.min("size").alias("least")).collect()
    if not counted:
        return {}
    share = max(min_bytes, max_bytes // len(counted))
    # a threshold on the hash that leaves about three times the documents that are needed, or all
    need = {r["lang"]: min(max_docs, int(share / r["mean"]) + 1) for r in counted if r["n"]}
    rate = {r["lang"]: min(1.0, (3.0 * need[r["lang"]] + 30) / r["n"]) for r in counted if r["n"]}
    longer = {r["lang"]: r["least"] for r in counted if not r["n"]}
    slot = F.xxhash64(F.lit("language"), "id")
    below = F.create_map(*[F.lit(x) for k, v in rate.items() for x in (k, v)]) if rate else None
    picked = []
    if rate:
        some = rows.filter(fits & (F.shiftrightunsigned(slot, 11) / float(1 << 53) < below[F.col("lang")]))
        by = Window.partitionBy("lang").orderBy(slot, "t")
        ranked = some.withColumn("k", F.row_number().over(by)).withColumn("before", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        picked = ranked.filter((F.col("k") <= max_docs) & (F.col("before") < share)).select("lang", "k", "t").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["k"])):
        out.setdefault(r["lang"], []).append(r["t"])
    texts = {k: " ".join(v).encode() for k, v in out.items()}
    if longer:
        least = F.create_map(*[F.lit(x) for k, v in longer.items() for x in (k, v)])
        width, many = 400, max(1, share // 400)
        stretch = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.substring("t", (i * F.length("t") / many + 1).cast("int"), F.lit(width)))
        shortest = rows.filter(F.col("size") == least[F.col("lang")]).groupBy("lang").agg(F.min_by("t", slot).alias("t")).select("lang", F.concat_ws(" ", stretch).alias("t"))
        texts |= {r["lang"]: r["t"].encode() for r in shortest.collect()}
    return texts


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] = (4, 2), max_bytes: int = 96_000, min_bytes: int = 2_000, max_doc_bytes: int = 4_000, max_docs: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred and score (how far the runner-up is behind) of every row."""
    spark = docs.sparkSession
    ship(spark)
    texts = training_texts(docs, id_col, text_col, lang_col, held_out, max_bytes, min_bytes, max_doc_bytes, max_docs)
    parser = spark.sparkContext.broadcast(Parser(texts)) if texts else None
    names = np.array(sorted(texts), dtype=object)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            buf, offsets = text_column(batch.column(1))
            lang, score = [], [np.zeros(0)]
            for i, j in row_blocks(offsets):
                worded = np.array([t.is_valid and letter.search(t.as_py()) is not None for t in batch.column(1).slice(i, j - i)], bool)
                if parser is None:
                    lang += ["und"] * (j - i)
                    score.append(np.zeros(j - i))
                    continue
                needed = parser.value.phrases(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) * parser.value.weight[:, None]
                best = needed.argmin(axis=0)
                low = needed[best, np.arange(j - i)]
                needed[best, np.arange(j - i)] = np.inf
                second = needed.min(axis=0)
                lang += np.where(worded, names[best], "und").tolist()
                score.append(np.where(worded, np.where(np.isinf(second), 1.0, 1 - low / np.maximum(second, 1e-9)), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.concatenate(score))], names=["doc_id", "lang_pred", "score"])

    found = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(trimmed(scan), f"doc_id {kind}, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % held_out[0] == held_out[1], F.lit(False)).alias("held_out"), "lang_pred", "score")
