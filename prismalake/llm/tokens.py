"""Token ids of whole texts with the ``tokenizers`` library, one call for each distinct word of a batch.

Both supported pre-tokenisers never join characters across the places where a text is cut here, so the ids of a text
are the ids of its parts one after another:

* ``words``: white space is dropped, so a text may be cut at every blank and line end.
* ``leading``: a blank belongs to the word after it. A text is cut before each blank or line end that follows a
  character that is not white space; texts with any other blank are encoded in one call.

A comma or full stop after a letter is a part of its own. Texts that hold the string of an added (special) token are
encoded in one call. The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_loaded: dict[str, WordCoder] = {}


def tokenizer_path(name: str) -> str:
    """Where the installed collection of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCoder:
    """Encodes batches of texts; keeps the ids of about ``held`` words between batches."""

    def __init__(self, path: str, style: str, held: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if style not in ("words", "leading"):
            raise ValueError(f"unknown style {style!r}")
        self.coder = Tokenizer.from_file(path)
        self.added = sorted(t.content for t in self.coder.get_added_tokens_decoder().values())
        self.style, self.held, self.seen = style, held, {}
        self.lower = self.plain(["A"]) == self.plain(["a"])
        self.marks = [np.array(ids, np.uint32) for ids in self.plain(["", "\n" if style == "leading" else "", ",", "."])]

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, atoms: list[str]) -> list[bytes]:
        """Ids of each atom: many in one call, with a separator that always is one token between them."""
        sep, mark = ("\n", "\n") if self.style == "leading" else (" | ", "|")
        (cut,) = self.plain([mark])[0]
        out: list[bytes] = [b""] * len(atoms)
        easy = pc.match_substring_regex(pa.array(atoms, pa.large_string()), "^ ?[!-{}~\u00c0-\u00ff]+$").to_pylist()
        regular = [i for i, (a, e) in enumerate(zip(atoms, easy)) if e or a and mark not in a and len(a.split()) == 1 and not a[-1].isspace() and (not a[0].isspace() or a[0] == " " and not a[1:2].isspace())]
        other = sorted(set(range(len(atoms))) - set(regular))
        for i in range(0, len(regular), 500):
            some = regular[i : i + 500]
            ids = np.array(self.plain([sep.join([atoms[k] for k in some])])[0], np.uint32)
            at = np.flatnonzero(ids == cut)
            if len(at) != len(some) - 1:
                other += some
                continue
            raw, edges = ids.tobytes(), [-1, *at.tolist(), len(ids)]
            for k, x, y in zip(some, edges, edges[1:]):
                out[k] = raw[4 * x + 4 : 4 * y]
        for k, ids in zip(other, self.plain([atoms[k] for k in other])):
            out[k] = np.array(ids, np.uint32).tobytes()
        return out

    def stems(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words one after another, and the length of each."""
        if len(self.seen) > self.held:
            self.seen = {}
        seen, names = self.seen, words.to_pylist()
        found = list(map(seen.get, names))
        new = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(new, self.joined([names[i] for i in new])):
            found[i] = seen[names[i]] = ids
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def parts(self, units: pa.Array, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units one after another, and the length of each. ``inner``: those that a blank stands before."""
        n = len(units)
        lead = np.zeros(n, bool)
        if self.style == "leading":
            lead = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
            units = pc.if_else(pa.array(lead), pc.utf8_slice_codeunits(units, 1), pc.if_else(pa.array(inner & ~lead), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, pa.scalar("", pa.large_string())), units))
        last = pc.match_substring_regex(units, "[A-Za-z\u00df-\u00f6\u00f8-\u00ff][,.]$").to_numpy(zero_copy_only=False)
        stop = pc.ends_with(units, ".").to_numpy(zero_copy_only=False)
        units = pc.if_else(pa.array(last), pc.utf8_slice_codeunits(units, 0, -1), units)
        if self.lower:
            units = pc.ascii_lower(units)
        coded = units.dictionary_encode()
        of = coded.indices.to_numpy().astype(np.int64)
        flat, sizes = self.stems(coded.dictionary)
        marks = np.array([len(m) for m in self.marks])
        begins = np.concatenate([np.cumsum(marks) - marks, np.cumsum(sizes) - sizes + marks.sum()])
        sizes = np.concatenate([marks, sizes])
        three = np.stack([lead.astype(np.int64), of + 4, np.where(last, np.where(stop, 3, 2), 0)], 1).ravel()
        each = sizes[three]
        return gathered(np.concatenate([*self.marks, flat]), begins[three], each), each.reshape(n, 3).sum(1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another (unsigned 32 bit) and the number of ids of each row; null is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        bad = np.zeros(n, bool)
        for name in self.added:
            bad |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if self.style == "leading" else " "), " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = lists.flatten().dictionary_encode()
        units, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        inner = np.ones(len(units), bool)
        rows = np.repeat(np.arange(n), np.diff(first))
        if self.style == "leading":  # a row's first unit has no blank before it; other white space makes a row irregular
            odd = np.fromiter((not w or w[-1].isspace() or w[0] == "\n" and w[1].isspace() for w in units.to_pylist()), bool, len(units))[at]
            bad[rows[odd]] = True
            heads = pa.array(at[first[:-1]]).dictionary_encode()
            at[first[:-1]] = len(units) + heads.indices.to_numpy()
            units = pa.concat_arrays([units, units.take(heads.dictionary)])
            inner = np.append(inner, np.zeros(len(heads.dictionary), bool))
        keep = ~bad[rows]
        used = np.zeros(len(units) + 1, bool)
        used[at[keep]] = True
        used = used[:-1]
        flat, sizes = self.parts(units.filter(pa.array(used)), inner[used])
        begins, sizes = np.append(np.cumsum(sizes) - sizes, 0), np.append(sizes, 0)
        place = np.where(keep, (np.cumsum(used) - 1)[at], len(sizes) - 1)
        each = sizes[place]
        ends = np.append(0, np.cumsum(each))
        lengths = ends[first[1:]] - ends[first[:-1]]
        ids = gathered(flat, begins[place], each)
        whole = np.flatnonzero(bad)
        if len(whole):
            by_row = dict(zip(whole.tolist(), self.plain(texts.take(pa.array(whole)).to_pylist())))
            bounds, out = np.append(0, np.cumsum(lengths)), []
            for r in range(n):
                out.append(np.array(by_row[r], np.uint32) if r in by_row else ids[bounds[r] : bounds[r + 1]])
            ids, lengths = np.concatenate(out), np.fromiter(map(len, out), np.int64, n)
        return ids, lengths


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` at ``begins`` one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]


def coder(path: str, style: str, held: int | None = None) -> WordCoder:
    """The worker's coder for a tokenizer file; ``held``: the ids of so many words are kept from now on."""
    if path not in _loaded:
        _loaded[path] = WordCoder(path, style)
    if held is not None:
        _loaded[path].held = held
    return _loaded[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with ``end`` appended to each."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end)), lengths + 1
