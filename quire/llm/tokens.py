"""Token ids and token counts by way of distinct pre-tokens.

A byte-level BPE never merges across pre-tokens, and a space or newline always starts a new one
unless three or more white-space characters meet, or two at a text's end.  So a text is cut before
spaces and newlines, Arrow's dictionary encoding finds the distinct cuts of a batch, each is handed
to the ``tokenizers`` library once, and the ids (or their counts) are gathered back by position.
Texts with such longer runs of white space are cut more carefully, by a regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are cut at once inside a task.
BATCH_BYTES = 16 << 20
#: Distinct cuts whose ids a Python worker remembers before it starts afresh.
CACHE_UNITS = 1_000_000

_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LONG_SPACES = rf"{_WHITE}{{3}}|{_WHITE}{{2}}\z"
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters that are neither letters, numbers, white space nor an apostrophe.
_TAIL = ".,;:!?%*#$&"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE for the 256 byte values, as a translate table."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _str_list(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """Encodes texts with one ``tokenizers`` file; ids come as numpy arrays over whole batches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.specials = [t.content for t in added]
        self.seen: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _piece(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's BPE model."""
        if not word.isascii():
            word = word.encode().decode("latin-1")
        return np.array([t.id for t in self.model.tokenize(word.translate(self.letters))], self.dtype).tobytes()

    def _tail(self, tail: str) -> bytes:
        known = self.tails.get(tail)
        if known is None:
            known = self._piece(tail)
            if len(self.tails) < 10_000:
                self.tails[tail] = known
        return known

    def _unit(self, unit: str) -> bytes:
        if unit[:1] == "\n" and unit[1:2].isalpha():
            return self._tail("\n") + self._unit(unit[1:])
        core = unit.rstrip(_TAIL)
        head = core[1:] if core[:1] == " " else core
        if head.isalpha():
            ids = self._piece(core)
            if len(core) == len(unit):
                return ids
            return ids + self._tail(unit[len(core) :])
        return np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, self.dtype).tobytes()

    def _table(self, units: list[str], prefix: str) -> list[bytes]:
        seen, out = self.seen, []
        for u in units:
            key = u if u[:1] == "\n" else prefix + u
            ids = seen.get(key)
            if ids is None:
                if len(seen) >= CACHE_UNITS:
                    seen.clear()
                ids = seen[key] = self._unit(key)
            out.append(ids)
        return out

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Per text the list of its units; those after the first that don't begin with a newline lack their space."""
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        hard = pc.match_substring_regex(texts, _LONG_SPACES)
        for s in self.specials:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        if not pc.any(hard).as_py():
            return cut
        out = []
        for text, units, careful in zip(texts.to_pylist(), cut.to_pylist(), hard.to_pylist(), strict=True):
            out.append(_SAFE_SPACE.split(text) if careful else units)
        return pa.array(out, cut.type)

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Unit codes of all texts in a row, the place where each text starts, and ids by code."""
        cut = self._cut(texts)
        starts = np.asarray(cut.offsets, np.int64)
        flat = cut.flatten()
        starts = starts - starts[0]
        firsts = starts[:-1]
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        table = self._table(_str_list(coded.dictionary), " ")
        opening = flat.take(pa.array(firsts)).dictionary_encode()
        codes[firsts] = opening.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(table)
        return codes, starts, table + self._table(_str_list(opening.dictionary), "")

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; no ids are laid out."""
        if not len(texts):
            return np.zeros(0, np.int64)
        codes, starts, table = self._codes(texts)
        each = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        return np.add.reduceat(each[codes], starts[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets): text i has ids[offsets[i]:offsets[i + 1]]."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        codes, starts, table = self._codes(texts)
        bank = np.frombuffer(b"".join(table), self.dtype)
        size = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        sizes = size[codes]
        ends = np.cumsum(sizes)
        place = np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(ends[-1])
        return bank[place], np.concatenate([[0], ends[starts[1:] - 1]])


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a tokenizer file; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def by_bytes(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of ``column``, a row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def strings(column: pa.Array) -> pa.Array:
    """Texts with nulls as empty strings, as 64-bit offset strings (no 2 GB limit)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


class PieceCounter:
    """Counts pieces of a sentencepiece model; the library works on whole texts, as pieces cross spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.array([len(x) for x in self.model.encode(texts.to_pylist(), num_threads=1)], np.int64)


class WholeCounter:
    """Counts by the tokenizers library over whole texts, for files other than byte-level BPE."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: pa.Array) -> np.ndarray:
        out = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
        return np.array([len(x.ids) for x in out], np.int64)


_COUNTERS: dict[str, object] = {}


def counter(path: str):
    """A counter for a .json (tokenizers) or .model (sentencepiece) file."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            _COUNTERS[path] = PieceCounter(path)
        else:
            import json

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            before = spec.get("pre_tokenizer") or {}
            plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and not spec.get("normalizer")
            _COUNTERS[path] = encoder(path) if plain and spec["model"]["type"] == "BPE" else WholeCounter(path)
    return _COUNTERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, name: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``id_col, n_bytes, n_tokens, over_limit``.

    Each distinct pre-token of a batch is counted once (and remembered by the worker), joined by
    code to the places where it stands in each text, and summed; ids are never laid out.
    Null text counts as empty (0 bytes, 0 tokens); a null id and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        count = counter(tokenizer_path(name)).counts
        for whole in batches:
            for b in by_bytes(whole, "t"):
                texts = strings(b.column("t"))
                n = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column("i"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
