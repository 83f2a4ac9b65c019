"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is split at safe boundaries into pieces whose counts add up to that of the
whole; distinct pieces that were not seen before are encoded together in batches of
bounded bytes, so a long text costs no more memory than a short one.

A boundary is safe for a tokenizer when nothing it does looks across it. ``safe_split``
tells from the vocabulary file: ``white`` (at ASCII white space) for tokenizers whose first
step is to cut at white space and drop it, with no step before that looks across it and no
added token that holds some; ``None`` for any other: then whole texts are encoded, in batches
of bounded bytes.

Defined results for odd input: a null text counts as empty and has no tokens; repeated
rows get equal counts; rows of one id are counted each by its own text; a null id is kept; a
text of exactly ``limit`` tokens is not over it; an empty table gives an empty result. Only
the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netlens.llm.common import by_bytes, texts_of, tidied, vocabulary_file

LIMIT = 2048
#: Pieces whose counts a worker remembers, and bytes of text handed to the encoder at once.
REMEMBERED, BATCH_BYTES = 400_000, 1 << 20
_SPACES = "\t\n\x0b\x0c\r "
_LOADED: dict[str, Encoder] = {}


#: Patterns of pre-tokenizers whose matches hold no white space; fixed values, as they stand in vocabulary files.
_WORDS_ONLY = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"\w+|[^\w\s]+", r"\S+"}


def _local(normalizer: dict | None) -> bool:
    """Whether a normalizer never looks across white space."""
    if normalizer is None:
        return True
    if normalizer["type"] == "Sequence":
        return all(map(_local, normalizer["normalizers"]))
    if normalizer["type"] == "Replace":
        return normalizer["pattern"] == {"Regex": r"\s+"} and normalizer["content"] == " "
    return normalizer["type"] in ("NFC", "NFD", "Lowercase")


def safe_split(path: str) -> str | None:
    """Where texts may be cut for the tokenizer of a vocabulary file: ``white`` or nowhere."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    first = made.get("pre_tokenizer") or {}
    while first.get("type") == "Sequence":
        first = (first.get("pretokenizers") or [{}])[0]
    kept = first.get("behavior") == "Removed" and first.get("invert") and first.get("pattern", {}).get("Regex") in _WORDS_ONLY
    drops = first.get("type") in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer") or (first.get("type") == "Split" and kept)
    added = any(set(t["content"]) & set(_SPACES) or t.get("lstrip") or t.get("rstrip") for t in made.get("added_tokens") or ())
    return "white" if drops and not added and _local(made.get("normalizer")) else None


class Encoder:
    """Counts tokens as the library of a vocabulary file gives them, without added special tokens."""

    def __init__(self, path: str, split: str | None):
        self.split, self.seen = split, {}
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            self.lengths = lambda texts: [len(e.ids) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
        else:
            raise ValueError(f"no library for {path}")

    def in_batches(self, texts: list[str]) -> Iterator[int]:
        """Lengths of the texts, encoded in batches of about equal bytes."""
        at, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t.encode("utf-8", "replace")) + 16
            if size >= BATCH_BYTES:
                yield from self.lengths(texts[at : i + 1])
                at, size = i + 1, 0
        if at < len(texts):
            yield from self.lengths(texts[at:])

    def counts(self, texts: list[str]) -> Iterable[int]:
        if self.split is None:
            return list(self.in_batches(texts))
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        table = str.maketrans(dict.fromkeys(_SPACES, " "))
        pieces = [t.translate(table).split(" ") if any(s in t for s in _SPACES[:-1]) else t.split(" ") for t in texts]
        new = list(set().union(*pieces).difference(self.seen)) if pieces else []
        self.seen.update(zip(new, self.in_batches(new), strict=True))
        get = self.seen.__getitem__
        return [sum(map(get, p)) for p in pieces]


def encoder(path: str, split: str | None) -> Encoder:
    """One encoder for each worker process and file."""
    key = f"{path}\n{split}"
    if key not in _LOADED:
        _LOADED[key] = Encoder(path, split)
    return _LOADED[key]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", split: str | None = "auto", doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per input row. ``split`` is told from the vocabulary unless given."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary_file(vocabulary)
        counter = encoder(path, safe_split(path) if split == "auto" else split)
        for batch in by_bytes(batches, "text", 2 << 20):
            n = pa.array(counter.counts(texts_of(batch, "text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])
        counter.seen.clear()  # workers live on after a task

    schema = T.StructType([kept.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return kept.mapInArrow(tidied(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
