"""Trimming of long joined runs against a plain quadratic version; names, stamps and digests that are no secrets; linear time."""

import random
import time

import public_tokenizers as public
import pytest

from scholia.llm import queries, secret_scan


@pytest.fixture(scope="module")
def efficiency():
    return secret_scan.Efficiency(queries.vocabulary("byte_bpe_50k.tiktoken"), public.PATTERN)


def stops_of(run, efficiency):
    out = [0]
    for size in efficiency.sizes(run):
        out.append(out[-1] + size)
    return out


def plain(run, start, end, stretches):
    """Words go one by one while what is left is a secret, each time looked at as a whole."""

    def secret(a, b):
        return b - a >= secret_scan.LEAST and any(c.isalpha() for c in run[a:b]) and not secret_scan.NAME.fullmatch(run, a, b) and stretches.dense(a, b)

    while (m := secret_scan._WORD_FIRST.match(run, start, end)) and secret(m.end(), end):
        start = m.end()
    while True:
        word = len(run[start:end].rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")) + start
        at = len(run[start:word].rstrip("_/=+-")) + start
        if at == word or not secret_scan._WORD.fullmatch(run, word, end) or not secret(start, at):
            return start, end
        end = at


def test_trimming_equals_the_plain_version(efficiency):
    rng, moved = random.Random(5), 0
    words = ["config", "x", "A", "name", "HTTP", "v2", "2024", "Path", "abc123", "q9", "20261127T190714Z"]
    noise = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rng.randint(3, 24)))
    for _ in range(600):
        parts = [rng.choice(words) if rng.random() < 0.7 else noise() for _ in range(rng.randint(1, 12))]
        run = "".join(p + rng.choice(["-", "/", "_", "--", "="]) for p in parts) + rng.choice(["", "end", "Zz"])
        stretches = secret_scan.Stretches(run, stops_of(run, efficiency))
        first = stretches.without_first_words(0, len(run))
        got = first, stretches.without_last_words(first, len(run))
        assert got == plain(run, 0, len(run), stretches), run
        moved += got != (0, len(run))
    assert moved > 50


def test_names_stamps_and_digests_are_no_secrets(efficiency):
    for text in (
        "x-x-x-x-x-x-x-x-x-x-x", "a=b=c=d=e=f=g=h=i=j", "20261127T190714Z-0001-0002", "backup_20261127T190714123Z_final_v2",
        "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", 'integrity="sha384-oqVuAfXRKap7fdgcCY5uykM6+R9GqQ8K/uxy9rx7HNQlGYl1kPzQho1wx4JwY8wC"',
    ):
        assert secret_scan.token_spans(text, efficiency) == [], text
    for text in ("Xk29dLq8Zp3Rw7Tn5Vb1", "x-x-x-" + "Xk29dLq8Zp3Rw7Tn5Vb1", "20261127T190714Z-Xk29dLq8Zp3Rw7Tn5Vb1"):
        assert secret_scan.token_spans(text, efficiency), text


def test_joined_runs_in_linear_time(efficiency):
    """1 MB of words of one letter and of long ones, before and after a random string."""
    k = 40_000
    for text in ("x-" * k + "configuration/management/" * k, "x-" * k + "configuration/management/" * k + "Xk29dLq8Zp3Rw7Tn5Vb1", "Xk29dLq8Zp3Rw7Tn5Vb1" + "/configuration-x" * k, "q9x-" * 4 * k + "configuration/" * k, "Xk29dLq8Zp3Rw7Tn5Vb1/word/" * k):
        began = time.perf_counter()
        secret_scan.token_spans(text, efficiency)
        assert time.perf_counter() - began < 15
