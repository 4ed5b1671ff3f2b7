import os
import random

import pytest

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="session")
def tokenizer_path():
    path = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("the tokenizer files are not here")
    return path


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def near_copies():
    """(doc_id, text): groups of exact and near copies, a shared passage, short, blank, null and repeated rows."""
    rng = random.Random(5)
    rows, passage = [], " ".join(words_of(rng, 60))
    for group in range(12):
        base = words_of(rng, rng.choice((40, 120, 300)))
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 8))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            rows.append(" ".join(copy) + (" " + passage if group % 3 == 0 else ""))
    rows += [passage + " " + " ".join(words_of(rng, 15)) for _ in range(15)]
    rows += ["one two", "One  two\n", "a b c d e", "a b c d", "", "   ", None, None, "Ärger über Öl", "ärger über öl", " ".join(words_of(rng, 6000))]
    rng.shuffle(rows)
    out = list(enumerate(rows, 100))
    return [*out, out[0], out[0]]
