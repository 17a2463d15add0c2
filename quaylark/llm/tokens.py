"""Token counts with a finite-state tokenizer.

A byte-pair vocabulary is compiled to a deterministic transducer over characters. A state
holds all that later input can depend on: the longest suffix that some vocabulary piece
continues, and for each cut inside that suffix the last token of the encoding up to the cut
with its token count relative to now. A transition is annotated with the change of the
token count. States are finite in number and made on first use (lazy determinisation).

No piece has a space mark after another character, so the state before a space that
follows something else is always the one after which a new word starts: the transducer is
synchronised there.

A long text is cut in chunks, which tasks map one by one. A chunk's map takes the states in
which the text before may leave the transducer to the state after the chunk and the tokens
in it; it is given for the states that reading some text ahead of the chunk leads to.
Maps compose associatively: a tree of joins puts neighbours together, level by level, and
the map of the whole text at the first state is its count. A text whose chunks enter in
other states is counted in one piece.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylark.llm.common import col, python_map, stash

SPACE = "▁"
#: Characters of a chunk; longer texts are dealt out over tasks.
CHUNK = 1 << 16
#: Characters ahead of a chunk from which its entering states are found.
AHEAD = (256, 4096)
#: Limits of the memo tables of one worker; a full table is emptied and grows again.
MAX_WORDS, MAX_STATES = 300_000, 200_000


class Transducer:
    """Counts the pieces that the sentencepiece BPE model at `path` gives a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.Normalize("ﬁ A  b") != f"{SPACE}ﬁ{SPACE}A{SPACE}{SPACE}b":
            raise ValueError("only models which leave text as it is can be compiled")
        #: Piece -> rank: of two merges the one of lower rank comes first.
        self.rank: dict[str, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i)):
                self.rank[model.id_to_piece(i)] = -model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("the vocabulary has a piece across words: no synchronising cut")
        self.starts = {p[:n] for p in self.rank for n in range(1, len(p))}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        # State 0: nothing read. A state is (suffix, ((last token, relative count), ...)),
        # one entry for each cut from the suffix's start to now.
        self.states: list[tuple] = [("", (("", 0),))]
        self.ids = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.words: dict[str, int] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge gives the piece; None if merging its text gives others."""
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2 and (found := self.best(parts)):
                parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
            self.halves[piece] = (parts[0], parts[1]) if len(parts) == 2 and self.best(parts) else None
        return self.halves[piece]

    def best(self, parts: list[str]) -> tuple[float, int] | None:
        """The merge that comes next: lowest rank, then leftmost."""
        return min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)

    def adjacent(self, a: str, b: str) -> bool:
        """Whether the encoding of a + b is just these two: undoing their merges latest first,
        no pair across the border would have been merged before its neighbours were."""
        ok = self.fits.get((a, b))
        if ok is not None:
            return ok
        if len(self.fits) > MAX_STATES:
            self.fits.clear()
        x, y, ok, rank = a, b, True, self.rank
        until = float("inf")  # the rank of the merge that ends this neighbourhood
        while ok:
            across = rank.get(x + y)
            if across is not None and across < until:
                ok = False
                break
            rx = rank[x] if len(x) > 1 else -1.0
            ry = rank[y] if len(y) > 1 else -1.0
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until, x = rx, self.split(x)[1]
            else:  # of equal ranks the left pair goes first, so one across wins a tie
                until, y = math.nextafter(ry, math.inf), self.split(y)[0]
        self.fits[a, b] = ok
        return ok

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change of the token count."""
        suffix, cuts = self.states[state]
        text = suffix + char
        for k in range(len(text)):  # longest candidate first
            if cuts[k] is None:
                continue
            piece = text[k:]
            last, before = cuts[k]
            if (len(piece) == 1 or piece in self.rank and self.split(piece)) and (not last or self.adjacent(last, piece)):
                break
        # A character outside the vocabulary becomes its bytes.
        delta = before + (1 if piece in self.rank else len(piece.encode("utf-8", "surrogatepass")))
        grown = [c or ("", 0) for c in cuts] + [(piece, delta)]
        k = 0
        while k < len(text) and text[k:] not in self.starts:
            k += 1
        # No piece goes on from some cuts: they are forgotten, so that more prefixes share a state.
        starts = self.starts
        kept = (*((t, n - delta) if text[i:] in starts else None for i, (t, n) in enumerate(grown[k:-1], k)), (piece, 0))
        key = (text[k:], kept)
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        self.arcs[state][char] = to, delta
        return to, delta

    def word(self, text: str) -> int:
        """Tokens of the characters between two synchronising cuts."""
        n = self.words.get(text)
        if n is None:
            if len(self.states) > MAX_STATES:
                self.reset()
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            state = n = 0
            for c in text:
                arc = self.arcs[state].get(c) or self.step(state, c)
                state, n = arc[0], n + arc[1]
            if len(text) <= 64:
                self.words[text] = n
        return n

    def between(self, text: str) -> int:
        """Tokens of text that starts and ends at synchronising cuts."""
        return sum(map(self.word, cut(text)))

    def count(self, text: str) -> int:
        return self.between(SPACE + text.replace(" ", SPACE)) if text else 0

    def advance(self, text: str, state: str) -> tuple[str, int]:
        """The state after the text, from a state before it, and the tokens in between.
        States go by their content, so that every worker knows them."""
        before, suffix, cuts = json.loads(state)
        key = (suffix, tuple(None if c is None else tuple(c) for c in cuts))
        now, n = self._number(key), 0
        for i, c in enumerate(text):
            if c == SPACE != before and before:
                now = 0
            if len(self.states) > MAX_STATES:
                key = self.states[now]
                self.reset()
                now = self._number(key)
            arc = self.arcs[now].get(c) or self.step(now, c)
            now, n, before = arc[0], n + arc[1], c
        suffix, cuts = self.states[now]
        return json.dumps([before, suffix, cuts]), n

    def _number(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.arcs.append({})
        return self.ids[key]

    def chunk(self, text: str, entering: list[str]) -> list[tuple[str, str, int]]:
        """A chunk's map: (state before, state after, tokens) for each entering state."""
        first = next((i for i in range(1, len(text)) if text[i] == SPACE != text[i - 1]), 0)
        if not first:
            return [(e, *self.advance(text, e)) for e in entering]
        words = cut(text[first:])
        after, last = self.advance(words[-1], START)
        n = sum(map(self.word, words[:-1])) + last
        out = []
        for e in entering:
            state, head = self.advance(text[:first], e)
            out.append((e, after, head + n))
        return out


#: The state in which nothing has been read.
START = json.dumps(["", "", [["", 0]]])


def composed(left: list[tuple[str, str, int]], right: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The map of two neighbours: through the states that the left one leads to and that
    the right one knows."""
    known = {a: (b, n) for a, b, n in right}
    return [(a, known[b][0], n + known[b][1]) for a, b, n in left if b in known]


def cut(text: str) -> list[str]:
    """The text's parts between synchronising cuts: space marks, then other characters."""
    out, marks = [], ""
    parts = text.split(SPACE)
    if parts[0]:
        out.append(parts[0])
    for p in parts[1:]:
        marks += SPACE
        if p:
            out.append(marks + p)
            marks = ""
    if marks:
        out.append(marks)
    return out


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of this worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


_MAP = "array<struct<before:string,after:string,n:bigint>>"


def _named(maps: list[tuple[str, str, int]]) -> list[dict]:
    return [dict(zip(("before", "after", "n"), m)) for m in maps]


def _tree(maps: DataFrame) -> DataFrame:
    """(row, map) of the whole texts, from stored maps(row, part, map) of their chunks: on each
    level every second part is joined with its right neighbour."""
    last = maps.agg(F.max("part")).first()[0] or 0
    while last:
        left = maps.where(F.col("part") % 2 == 0).select("row", F.expr("part div 2").cast("int").alias("part"), "map")
        right = maps.where(F.col("part") % 2 == 1).select("row", F.expr("part div 2").cast("int").alias("part"), F.col("map").alias("next"))

        def make():
            plain = lambda m: [(x["before"], x["after"], x["n"]) for x in m]
            return lambda b: {"both": [m if n is None else _named(composed(plain(m), plain(n))) for m, n in zip(b["map"], b["next"])]}

        both = python_map(left.join(right, ["row", "part"], "left"), make, f"both {_MAP}", ["row", "part"], ["map", "next"])
        maps, last = stash(both.withColumnRenamed("both", "map")), last // 2
    return maps.select("row", "map")


def token_counts(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row a document: id, n_bytes and n_tokens of its whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row is
    counted by itself. Other columns are ignored, whatever their names; an empty table gives
    none. Texts up to `chunk` characters are counted where they are read, without a shuffle;
    only longer ones are cut in chunks, dealt out, and their maps composed by row.
    """
    rows = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    sized = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    ahead = max(AHEAD)

    def whole():
        t = compiled(model_path)
        return lambda b: {"n_tokens": [t.count(x) for x in b["text"]]}

    def mapped():
        t = compiled(model_path)

        def states(part: int, before: str) -> list[str]:
            if part == 0:
                return [START]
            at_start = part * chunk <= ahead
            before = (SPACE if at_start else "") + before.replace(" ", SPACE)
            return list(dict.fromkeys(t.advance(before if at_start else before[-n:], START)[0] for n in AHEAD))

        def run(b):
            texts = [(SPACE if i == 0 else "") + x.replace(" ", SPACE) for i, x in zip(b["part"], b["piece"])]
            return {"map": [_named(t.chunk(x, states(i, a))) for i, a, x in zip(b["part"], b["before"], texts)]}

        return run

    long_ = F.char_length("text") > chunk
    short = python_map(sized.where(~long_), whole, "n_tokens long", ["doc_id", "n_bytes"])
    held = stash(sized.where(long_).withColumn("row", F.monotonically_increasing_id()))

    def cut():
        def pieces(x: str) -> list[dict]:
            return [{"part": a // chunk, "before": x[max(0, a - ahead) : a], "piece": x[a : a + chunk]} for a in range(0, len(x), chunk)]

        return lambda b: {"pieces": [pieces(x) for x in b["text"]]}

    # A text is cut in one pass; only its pieces are dealt out.
    own = python_map(held.select("row", "text"), cut, "pieces array<struct<part:int,before:string,piece:string>>", ["row"])
    pieces = own.select("row", F.inline("pieces")).repartition("row", "part")
    maps = _tree(stash(python_map(pieces, mapped, f"map {_MAP}", ["row", "part"], ["part", "before", "piece"])))
    found = maps.select("row", F.get(F.filter("map", lambda m: m["before"] == START), F.lit(0))["n"].alias("n_tokens"))
    joined = held.join(found, "row", "left")
    done = joined.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    rest = python_map(joined.where("n_tokens is null").select("doc_id", "n_bytes", "text"), whole, "n_tokens long", ["doc_id", "n_bytes"])
    return short.unionByName(done).unionByName(rest)
