"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text accepts every substring of it. A text
is parsed greedily into the longest phrases that occur in the language's text; the language
that needs the fewest phrases for each symbol wins (ties: the smaller name). Automata are
completed to transition arrays, and a task walks all of them through many blocks of text at
once. A block of 2048 symbols begins a new phrase, alike for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiweave.llm.common import slices, whole_text

UNDETERMINED = "und"
RESULT = "struct<lang_pred:string,score:double,known:boolean>"
#: Labelled texts that each language learns from, and pieces of PIECE characters taken evenly over each.
SAMPLE_TEXTS, PIECES, PIECE = 96, 6, 64
#: Symbols of labelled text in a language's automaton.
SAMPLE_BYTES = 24 << 10
BLOCK = 2048
RUN_BYTES = 1 << 20
#: How strongly the confidence follows the surplus of phrases of the other languages.
SHARPNESS = 10.0
#: Standard deviations by which phrases must pass what a text in the language has, before they speak against it.
DEVIATIONS = 3.0

_DROPPED = bytes(b for b in range(128) if not chr(b).isalpha() and not chr(b).isspace())
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", b" " * 9)


def symbols(text: str) -> bytes:
    """The text in lower case without ASCII digits and punctuation; white space is a space."""
    return text.lower().encode().translate(_SPACES, _DROPPED.translate(None, b"\x1c\x1d\x1e\x1f"))


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts all substrings of the text; 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for byte in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = new
            at = link[at]
        if at >= 0:
            to = moves[at][byte]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                twin = len(moves)
                moves.append(dict(moves[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at >= 0 and moves[at].get(byte) == to:
                    moves[at][byte] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return moves


class Parser:
    """The automata of all languages as one transition array.

    An entry is (place of the next state) * 4 + the phrases that end here: on a missing move
    the phrase ends and the next one begins with the symbol; a symbol that the language's text
    lacks is a phrase of its own.
    """

    def __init__(self, samples: tuple[tuple[str, bytes], ...]) -> None:
        self.names = [name for name, _ in samples]
        known = sorted(set(b"".join(text for _, text in samples)))
        self.alphabet = bytes(known)
        self.kind_of = np.full(256, len(known), np.uint8)
        self.kind_of[known] = np.arange(len(known))
        width = len(known) + 1
        automata = [suffix_automaton(text) for _, text in samples]
        self.roots = (np.cumsum([0, *map(len, automata)])[:-1] * width).tolist()
        size = sum(map(len, automata)) * width
        # One array, filled in place: no second copy of it stands beside it.
        self.step = np.empty(size, np.int32 if size < 1 << 29 else np.int64)
        for at, moves in zip(self.roots, automata, strict=True):
            grid = self.step[at : at + len(moves) * width].reshape(-1, width)
            grid[0] = at * 4 + 1  # from the start, unknown symbol
            for byte, to in moves[0].items():
                grid[0, self.kind_of[byte]] = (at + to * width) * 4
            grid[1:] = grid[0] + 1
            for state, ways in enumerate(moves):
                if state:
                    for byte, to in ways.items():
                        grid[state, self.kind_of[byte]] = (at + to * width) * 4
        # Phrases for each symbol where a language's own symbols stand in random order; 0 where there are none.
        dice = np.random.default_rng(0)
        mixed = [bytes(dice.permutation(np.frombuffer(text, np.uint8))) for _, text in samples]
        found = np.diagonal(self.phrases(mixed))
        self.random_rate = found / np.maximum(1, [len(text) for text in mixed])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = self.kind_of[np.frombuffer(b"".join(texts), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        count = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(texts)), count)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin, length = starts[text] + rank * BLOCK, np.minimum(BLOCK, sizes[text] - rank * BLOCK)
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        roots = np.array(self.roots, self.step.dtype)[:, None] * 4
        state = np.repeat(roots, len(order), axis=1)
        ended = np.zeros(state.shape, np.int32)
        longest = int(length[0]) if len(length) else 0
        for j, k in enumerate(np.searchsorted(-length, -np.arange(longest), side="left").tolist()):
            now = self.step[(state[:, :k] >> 2) + data[begin[:k] + j]]
            ended[:, :k] += now & 3
            state[:, :k] = now & ~3
        ended += state != roots
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for column in range(len(self.names)):
            out[:, column] = np.bincount(text[order], ended[column], len(texts))
        return out


    def known(self, texts: list[bytes], found: np.ndarray) -> np.ndarray:
        """Which texts a learned language may have; ``found`` are their phrases.

        A language is ruled out by itself, whatever the others are: where the phrases that a mismatch
        ended are no fewer than in its symbols in random order, and more than chance gives a text with
        half of that (one in the language has about a third). So short texts, and texts that several
        languages parse well, stay. Texts of which half or more are symbols that no language has are in none.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        lacking = np.array([len(t.translate(None, self.alphabet)) for t in texts], np.int64)
        misses = found - -(-sizes[:, None] // BLOCK)
        chance = sizes[:, None] * self.random_rate
        ruled_out = misses >= np.maximum(chance, chance / 2 + DEVIATIONS * np.sqrt(chance / 2))
        return ~ruled_out.all(axis=1) & (2 * lacking < sizes)


def samples_of(docs: DataFrame, text: str, lang: str, doc_id: str) -> tuple[tuple[str, bytes], ...]:
    """At most SAMPLE_BYTES symbols for each language, from SAMPLE_TEXTS texts with the least hashes.

    The ids are chosen from the id and label columns alone; pieces are cut in the tasks, so what
    comes to the driver is bounded by languages x SAMPLE_TEXTS x PIECES x PIECE.
    """
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("id"), "id"))
    labelled = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("name")).where("name is not null and id is not null")
    ids = [r["id"] for r in labelled.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).select("id").distinct().collect()]
    whole = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("name"), whole_text(text).alias("t"))
    size = F.char_length("t")
    piece = [F.substring("t", (size * i / PIECES).cast("int") + 1, F.lit(PIECE)) for i in range(PIECES)]
    rows = whole.where(F.col("id").isin(ids) & F.col("name").isNotNull()).select("name", "id", F.concat_ws(" ", *piece).alias("t"))
    texts: dict[str, list[bytes]] = {}
    for row in sorted(rows.distinct().collect()):
        texts.setdefault(row["name"], []).append(symbols(row["t"]))
    return tuple((name, b" ".join(t)[:SAMPLE_BYTES]) for name, t in sorted(texts.items()))


def predictor(spark: SparkSession, samples: tuple[tuple[str, bytes], ...]):
    """A column function: text to the language, a confidence from 0 to 1, and whether any language is not ruled out.

    The parser is built once, on the driver, and sent as a broadcast of bounded size: about 5 MB a language
    (two states for each of SAMPLE_BYTES symbols, four bytes for each symbol of the alphabet).
    """
    sent = spark.sparkContext.broadcast(Parser(samples) if samples else None)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = sent.value
        for batch in batches:
            names, scores, known = [], [], []
            for run in slices(batch, RUN_BYTES):
                raw = [(t or b"").decode() for t in run.to_pylist()]
                letters = [any(map(str.isalpha, t)) for t in raw]
                if parser is None:
                    names, scores, known = names + [UNDETERMINED] * len(raw), scores + [0.0] * len(raw), known + [False] * len(raw)
                    continue
                texts = [symbols(t) for t in raw]
                found = parser.phrases(texts)
                best = found.argmin(axis=1)
                least = np.maximum(1, found.min(axis=1, keepdims=True))
                share = 1 / np.exp(-SHARPNESS * (found - found.min(axis=1, keepdims=True)) / least).sum(axis=1)
                names += [parser.names[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters, strict=True)]
                scores += [s if ok else 0.0 for s, ok in zip(share.tolist(), letters, strict=True)]
                known += (parser.known(texts, found) & np.array(letters, bool)).tolist()
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score", "known"])

    return predict


def identify(docs: DataFrame, learn_from: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
             result: str = "language") -> DataFrame:
    """``docs`` with a column ``result`` of ``lang_pred``, ``score`` and ``known``, learned from ``learn_from``.

    Null texts and texts without a letter are ``und`` with score 0 and not known, as is everything where
    no row is labelled. ``known`` is false too where the text speaks against every learned language.
    Ties go to the smaller name; repeated rows get the same answer. Further columns stay; one named as the result is replaced.
    """
    return docs.withColumn(result, predictor(docs.sparkSession, samples_of(learn_from, text, lang, doc_id))(whole_text(text)))
