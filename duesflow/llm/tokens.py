"""Token ids of whole texts by a public tokenizer file, with a bounded word cache."""

from __future__ import annotations


# Marks that the tokenizer cuts from a letter or digit before them; no apostrophe, no part of a special token.
TAIL = b'.,;:!?%&$*#)("-'


def _parted(word: bytes) -> tuple[bytes, bytes] | None:
    """The word without the marks at its end, and these, where the tokenizer codes the two apart."""
    core = word.rstrip(TAIL)
    if not core or len(core) == len(word):
        return None
    last = core[-4:].decode("utf-8", "ignore")[-1:]
    return (core, word[len(core):]) if last.isalpha() or last in "0123456789" else None


class WordCoder:
    """Ids of texts as little-endian uint32 bytes.

    The tokenizer never joins characters over ASCII white space, so each word is encoded
    once and its ids are kept. Words are kept in two tables of at most ``cache`` words: when
    the younger is full it becomes the older, whose words move back as they are met again.
    New words are encoded in one call, a special token between them.
    """

    def __init__(self, path: str, cache: int = 300_000, longest: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = {i: t for i, t in self._tokenizer.get_added_tokens_decoder().items() if t.special}
        self._mark = max(special) if special else None
        self._between = special[self._mark].content if special else None
        probe = self._tokenizer.encode_batch_fast(["Az", "az"], add_special_tokens=False)
        self._lowers = probe[0].ids == probe[1].ids
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._cache, self._longest = cache, longest

    def _folded(self, text: bytes) -> bytes:
        """ASCII letters in lower case where the tokenizer does so itself, as long as that makes no special token."""
        return text.lower() if self._lowers and b"<|" not in text else text

    def _coded(self, words: list[bytes]) -> list[bytes]:
        import numpy as np

        texts = [w.decode("utf-8", "replace") for w in words]
        if self._between is not None and not any(self._between in t for t in texts):
            joined = self._between.join(texts)
            ids = np.array(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(ids == self._mark)
            if len(ends) == len(words) - 1:
                data = ids.tobytes()
                bounds = zip([0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True)
                return [data[4 * a:4 * b] for a, b in bounds]
        coded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; texts of some hundred thousand characters at a time serve best."""
        young, old = self._young, self._old
        split, found, new = [], [], set()
        for text in texts:
            words = self._folded(text.encode("utf-8", "surrogatepass")).split()
            ids = list(map(young.get, words))
            split.append(words)
            found.append(ids)
            if None in ids:
                new.update(w for w, i in zip(words, ids, strict=True) if i is None)
        young.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in young]
        parts = {word: part for word in new if (part := _parted(word))}
        wanted = {p for part in parts.values() for p in part}
        wanted.update(w for w in new if w not in parts)
        wanted = {w for w in wanted if w not in young}
        young.update((w, old[w]) for w in wanted if w in old)
        fresh = [w for w in wanted if w not in young]
        for at in range(0, len(fresh), 20_000):
            some = fresh[at:at + 20_000]
            young.update(zip(some, self._coded(some), strict=True))
        young.update((w, young[a] + young[b]) for w, (a, b) in parts.items())
        out = [b"".join([young[w] if i is None else i for w, i in zip(words, ids, strict=True)] if None in ids else ids)
               for words, ids in zip(split, found, strict=True)]
        for word in {*new, *wanted}:
            if len(word) > self._longest:
                del young[word]
        if len(young) >= self._cache:
            self._young, self._old = {}, young
        return out


def worker_coder(path: str) -> WordCoder:
    """The coder of this Python worker, which keeps its words from task to task.

    Functions shipped by value have globals of their own in every task, so the coder is
    kept in a module made for it. Its size is bounded; a new worker starts with none.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_kept_word_coders", types.ModuleType("_kept_word_coders"))
    if path not in vars(kept):
        setattr(kept, path, WordCoder(path, cache=400_000))
    return getattr(kept, path)


def forget_coders() -> None:
    """Drop the words that this Python worker keeps; operators with large tables of their own call it in their tasks."""
    import sys

    kept = sys.modules.get("_kept_word_coders")
    if kept is not None:
        for name in [n for n in vars(kept) if not n.startswith("__")]:
            delattr(kept, name)


def coded_texts(coder: WordCoder, batches, size: int = 300_000):
    """(id, ids) of (id, text) batches, texts of about ``size`` characters at a time; NULL texts are empty."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys.append(key)
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= size:
                yield from zip(keys, coder.encode(texts), strict=True)
                keys, texts, held = [], [], 0
    yield from zip(keys, coder.encode(texts), strict=True)
