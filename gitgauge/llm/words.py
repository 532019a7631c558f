"""Exact token ids of whole texts through a tokenizer whose pre-tokens never span ASCII white space.

Texts are cut at ASCII white space by Arrow, a column at a time. Distinct pieces of printable ASCII without an apostrophe are cut on into
pre-tokens ("and", "And," and "and." share one), others are left to the tokenizer's own rules; the library encodes what is distinct
once per Python worker, and the ids of all pieces are gathered by place. The memo is a cache of bounded size and changes no result. ``exact_at_space`` checks that
the tokenizer works this way; any other tokenizer is called on whole texts.
"""

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

MEMO_WORDS = 700_000  # pieces and pre-tokens kept per worker
_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PLAIN = "^[!-&(-~]*$"  # printable ASCII without space and apostrophe, where the rule comes to letters, a digit or a run of others
_SPACE = re.compile("[ \t\n\r]+")
_LOADED = {}


def exact_at_space(rules: dict) -> bool:
    """True if white space is dropped before merging and nothing (normaliser, added tokens) looks across it."""
    normal = (rules.get("normalizer") or {}).get("normalizers", [])
    kinds = {n["type"] for n in normal}
    pre = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        rules["model"]["type"] == "BPE" and kinds <= {"NFC", "Replace", "Lowercase"}
        and all(n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normal if n["type"] == "Replace")
        and bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
        and "[^\\s" in pre[0]["pattern"].get("Regex", "")
        and all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in pre[1:])
        and not any(a["lstrip"] or a["rstrip"] or a["normalized"] or _SPACE.search(a["content"]) for a in rules["added_tokens"])
    )


def _gathered(ids, bounds, at):
    """The runs of ids numbered ``at`` one after the other, and their bounds."""
    n = np.diff(bounds)[at]
    ends = np.concatenate([[0], np.cumsum(n)])
    return ids[np.repeat(bounds[at] - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    """ids of a text as little-endian unsigned 32-bit integers; one per worker and vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = exact_at_space(rules)
        self.joins_by_space = rules.get("decoder") is None
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.memo = {"": b""}
        suffix = rules["model"].get("end_of_word_suffix")
        self.by_pre_token = self.by_piece and bool(suffix) and rules["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _RULE}
        self.lowers = any(n["type"] == "Lowercase" for n in (rules.get("normalizer") or {}).get("normalizers", []))
        self.added = [a["content"] for a in rules["added_tokens"]]
        self.last = np.array([bool(suffix) and (n or "").endswith(suffix) for n in self.names])  # ids that end a pre-token

    def _library(self, texts):
        """Many texts; several are joined by a space for one call, since ids do not change across it."""
        if not self.by_piece:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        out = []
        for i in range(0, len(texts), 500):
            group = texts[i:i + 500]
            e = self.tokenizer.encode(" ".join(group), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in group])
            ids = np.array(e.ids, "<u4")
            first = np.fromiter((o[0] for o in e.offsets), np.int64, len(ids))
            cut = np.searchsorted(first, starts)
            out += [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        return out

    def _pre_tokens(self, new):
        """ids of distinct pre-tokens."""
        ids = [np.array(self.tokenizer.encode(" ".join(new[i:i + 500]), add_special_tokens=False).ids, "<u4") for i in range(0, len(new), 500)]
        ids = np.concatenate([np.zeros(0, "<u4"), *ids])
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        if len(ends) != len(new):
            return self._library(new)
        data = ids.tobytes()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def _encoded(self, new):
        """ids of distinct pieces."""
        if not self.by_pre_token:
            return self._library(new)
        single = [p.isascii() and p.isalpha() for p in new]
        ours = iter(self._pre_tokens([p for p, own in zip(new, single) if own]))
        others = iter(self._library([p for p, own in zip(new, single) if not own]))
        return [next(ours if own else others) for own in single]

    def _cut(self, pieces: pa.Array):
        """The pieces as lists of pieces that are encoded on their own."""
        if self.by_pre_token:
            plain = pc.match_substring_regex(pieces, _PLAIN)
            for a in self.added:
                plain = pc.and_not(plain, pc.match_substring(pieces, a))
            lower = pc.ascii_lower(pieces) if self.lowers else pieces
            pieces = pc.if_else(plain, pc.replace_substring_regex(lower, "([0-9]|[^A-Za-z0-9]+)", " \\1 "), pieces)
        return pc.split_pattern(pieces, " ")

    def learn(self, pieces):
        """Encodes the pieces that the memo lacks; returns a mapping that has them all."""
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO_WORDS:
            self.memo = memo = {"": b""}
            new = [p for p in pieces if p]
        memo.update(zip(new, self._encoded(new)))
        return memo

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """ids of each text of a string column without nulls."""
        if not self.by_piece:
            return self._library(column.to_pylist())
        for space in "\t\n\r":
            column = pc.replace_substring(column, space, " ")
        pieces = pc.split_pattern(column, " ")
        coded = pieces.flatten().dictionary_encode()
        cut = self._cut(coded.dictionary)
        parts = cut.flatten().dictionary_encode()
        names = parts.dictionary.to_pylist()
        memo = self.learn(names)
        known = [memo[p] for p in names]
        bounds = np.cumsum([0, *map(len, known)]) >> 2
        ids, bounds = _gathered(np.frombuffer(b"".join(known), "<u4"), bounds, parts.indices.to_numpy())
        ids, bounds = _gathered(ids, bounds[cut.offsets.to_numpy()], coded.indices.to_numpy())
        ids, bounds = ids.tobytes(), (4 * bounds)[pieces.offsets.to_numpy()].tolist()
        return [ids[a:z] for a, z in zip(bounds, bounds[1:])]

    def decode(self, ids) -> str:
        """As the library's decode(ids, skip_special_tokens=False); without a decoder that is the tokens with spaces between."""
        if self.joins_by_space:
            names = self.names
            return " ".join([names[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
