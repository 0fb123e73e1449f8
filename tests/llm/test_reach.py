"""Edits by the places they reach."""

import random

from lodestone.llm import _edits

from .test_lines import distance


def _changed(r: random.Random, a: str, edits: int, letters: str) -> str:
    b = list(a)
    for _ in range(edits):
        k = r.randrange(len(b))
        b[k : k + 1] = r.choice([[], [r.choice(letters)], [b[k], r.choice(letters)]])
    return "".join(b)


def test_like_lines_are_compared_at_few_places(monkeypatch):
    """Pairs of four edits in 600 characters, of which 60 may be edited."""
    r = random.Random(1)
    s = ["".join(r.choices("abcdefgh ", k=600)) for _ in range(100)]
    t = [_changed(r, a, 4, "xyz") for a in s]
    asked, alike = [], _edits._Strings.alike

    def counted(self, i, j):
        asked.append(len(i))
        return alike(self, i, j)

    monkeypatch.setattr(_edits._Strings, "alike", counted)
    assert _edits.within(s, t, 0.1).all() and sum(asked) < 100 * 40


def test_many_letters_and_moved_parts():
    """Alphabets of one, two and four bytes; parts put in and taken out, so that ways stray from the diagonal; near the limit."""
    r = random.Random(4)
    s, t = [], []
    for letters in ("ab", "".join(map(chr, range(0x4E00, 0x4E00 + 700))), "a\U0001f600\ud800é\0"):
        for _ in range(60):
            a = "".join(r.choices(letters, k=r.randint(1, 120)))
            b, k = _changed(r, a, r.randint(0, len(a) // 10), letters), r.randrange(len(a))
            part = "".join(r.choices(letters, k=r.randint(0, 8)))
            b = r.choice([b, b[:k] + part + b[k:], part + b[: len(b) - len(part)], b[:k] + b[k + len(part) :]])
            s.append(a)
            t.append(b)
    for share in (0.1, 0.25):
        want = [distance(a, b) <= int(max(len(a), len(b)) * share + 1e-9) for a, b in zip(s, t, strict=True)]
        assert _edits.within(s, t, share).tolist() == want == _edits.within(s, t, share, False).tolist() and 30 < sum(want) < 170
