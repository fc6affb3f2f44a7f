"""Token counts by the whole-token shortcut.

Before the corpus is read, every vocabulary string is put through the tokenizer: those that its normaliser leaves as they
are, that its pre-tokenizer leaves in one piece and that its model answers with exactly their own token are proven whole
tokens. A pre-token that is a whole token counts one without any merge; only the rest goes through the model.

Tasks cut texts at ASCII white space, look at the distinct chunks of a piece of text, and cut those into pre-tokens with
the tokenizer's own normaliser and pre-tokenizer. This is only right for a tokenizer whose steps never look across white
space and drop it; ``WordTokens`` refuses all others. No text is shuffled.

Null and empty texts have no tokens. Every row is counted, repeated ids and rows too, and null ids are kept; columns
besides id and text are not read; an empty table gives an empty result. A task holds a piece of text or one long
text, at about ten bytes for each byte of it; a chunk is merged as a whole, as the tokenizer does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentflow.llm.common import give_back, pieces, read, text_bytes
from contentflow.llm.spans import chunk_spans, distinct_spans

LIMIT = 2048
REMEMBERED = 500_000  # chunks and pre-tokens whose counts a task remembers; others are counted again

COUNTS = "id bigint, n_bytes bigint, n_tokens bigint"


def _steps(part: dict | None, inner: str) -> list[dict]:
    if part is None:
        return []
    return [s for p in part[inner] for s in _steps(p, inner)] if part["type"] == "Sequence" else [part]


def _checked(spec: dict) -> dict:
    """The tokenizer's JSON, if its steps work between white space only and drop white space."""
    for step in _steps(spec["normalizer"], "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if step["type"] not in ("NFC", "NFD", "Lowercase") and not spaces:
            raise ValueError(f"normaliser {step['type']} may look across white space")
    first, *others = _steps(spec["pre_tokenizer"], "pretokenizers") or [{"type": "none"}]
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"]:
        raise ValueError("the pre-tokenizer must keep the matches of a pattern and drop white space")
    for step in others:
        if step["type"] != "ByteLevel" or step["use_regex"] or step["add_prefix_space"]:
            raise ValueError("the pre-tokenizer may only map bytes after its pattern")
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"] or any(map(str.isspace, token["content"])):
            raise ValueError(f"added token {token['content']!r} looks at its surroundings")
    if spec["model"]["type"] != "BPE" or spec["model"]["dropout"]:
        raise ValueError("the model must be BPE without dropout")
    return spec


class WordTokens:
    """The steps of a tokenizer file, one by one."""

    def __init__(self, raw: str):
        import regex
        from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

        spec = _checked(json.loads(raw))
        self.whole_text = Tokenizer.from_str(raw)  # added tokens as the file has them
        self.whole_text.no_truncation()
        self.whole_text.no_padding()
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.normaliser = self.whole_text.normalizer or normalizers.Sequence([])
        pattern = _steps(spec["pre_tokenizer"], "pretokenizers")[0]["pattern"]
        kind = pattern["Regex"] if "Regex" in pattern else None
        self.cut = pre_tokenizers.Split(Regex(kind) if kind is not None else pattern["String"], "removed", invert=True)
        if [p for p, _ in self.cut.pre_tokenize_str(" \t\n\v\f\r")]:
            raise ValueError("the pre-tokenizer must drop white space")
        self.lower = any(s["type"] == "Lowercase" for s in _steps(spec["normalizer"], "normalizers"))
        self.plain_cut = regex.compile(kind if kind is not None else regex.escape(pattern["String"])).findall
        self.to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.model = self.whole_text.model

    def pretokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without ASCII white space. On printable ASCII a normaliser of the allowed kinds does no
        more than lower letters, and the classes of the pattern mean the same in every engine."""
        if chunk.isascii() and chunk.isprintable():
            return self.plain_cut(chunk.lower() if self.lower else chunk)
        return [p for p, _ in self.cut.pre_tokenize_str(self.normaliser.normalize_str(chunk))]

    def merged(self, pretoken: str) -> int:
        """Number of tokens of a pre-token, by the merges of the model."""
        if not (pretoken.isascii() and pretoken.isprintable()):  # the byte alphabet has printable ASCII as it is
            pretoken = "".join(p for p, _ in self.to_bytes.pre_tokenize_str(pretoken))
        return len(self.model.tokenize(pretoken))

    def strings(self) -> list[str]:
        """Vocabulary strings without the mark of a word's end, as text; those that aren't UTF-8 are left out."""
        from tokenizers import decoders

        end = self.model.end_of_word_suffix or ""
        to_text, out = decoders.ByteLevel(), set()
        for entry in self.whole_text.get_vocab(with_added_tokens=False):
            text = to_text.decode([entry.removesuffix(end)])
            if "�" not in text:
                out.add(text)
        return sorted(out)

    def proven(self) -> frozenset[str]:
        """Strings that alone are one pre-token, unchanged, and one token."""
        asked = [s for s in self.strings() if s and self.pretokens(s) == [s]]
        alone = self.whole_text.encode_batch(asked, add_special_tokens=False)
        return frozenset(s for s, e in zip(asked, alone) if len(e) == 1 and self.merged(s) == 1)


class Counter:
    """Tokens of chunks without ASCII white space; remembers a bounded number of them."""

    def __init__(self, raw: str, whole: frozenset[str]):
        self.steps, self.whole = WordTokens(raw), whole
        self.chunks: dict[bytes, int] = {}
        self.rest: dict[str, int] = {}
        self.merges = 0  # pre-tokens that went through the model

    def pretoken(self, text: str) -> int:
        if text in self.whole:
            return 1
        n = self.rest.get(text)
        if n is None:
            n = self.steps.merged(text)
            self.merges += 1
            if len(self.rest) < REMEMBERED:
                self.rest[text] = n
        return n

    def chunk(self, raw: bytes) -> int:
        n = self.chunks.get(raw)
        if n is None:
            text = raw.decode()
            if text in self.whole:
                return 1
            if any(t in text for t in self.steps.added):
                n = len(self.steps.whole_text.encode(text, add_special_tokens=False))
            else:
                n = sum(map(self.pretoken, self.steps.pretokens(text)))
            if len(self.chunks) < REMEMBERED:
                self.chunks[raw] = n
        return n


def count(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens) for each document, by the tokenizer file ``path``; strings of special tokens
    in a text count as the file says."""
    with open(path, encoding="utf-8") as file:
        raw = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((raw, WordTokens(raw).proven()))  # as large as the vocabulary
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = Counter(*shared.value)
        for batch in pieces(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            starts, ends, before = chunk_spans(data, off)
            of, index = distinct_spans(data, starts, ends)
            flat = data.tobytes()
            found = np.array([counter.chunk(flat[a:b]) for a, b in zip(starts[of].tolist(), ends[of].tolist())], np.int64)
            reached = np.append(0, np.cumsum(found[index]))[before]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(off), pa.int64()), pa.array(np.diff(reached), pa.int64())],
                                             names=["id", "n_bytes", "n_tokens"])
        del counter
        give_back()

    return rows.mapInArrow(run, COUNTS)


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count(read(spark, sf_dir, "documents"), P.path("word_bpe_49k.json")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
