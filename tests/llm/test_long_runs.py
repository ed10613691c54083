"""Personal data in texts that are one long run."""

import random
import re
import time

from clickloom.llm import pii


def test_long_runs_take_linear_time():
    for run in ("abcdef0123" * 40_000, "a" * 400_000, "a." * 200_000, "12 " * 130_000, "+1 " * 130_000, "@a" * 200_000):
        start = time.perf_counter()
        list(pii._MAIL_RUN.finditer(run + " me@example.org"))
        assert time.perf_counter() - start < 1
    text = "0123456789abcdef" * 25_000 + " me@example.org"
    start = time.perf_counter()
    assert [m[0] for m in pii._MAIL_RUN.finditer(text)] == ["me@example.org"]
    assert [s for s in pii.matches(text) if s[0] == "email"] == [("email", len(text) - 14, len(text), True)]
    assert time.perf_counter() - start < 1


def test_runs_are_those_of_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+(?:@[A-Za-z0-9._%+-]+)+")
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.@@ -,") for _ in range(rng.randint(0, 25)))
        assert [m.span() for m in plain.finditer(text)] == [m.span() for m in pii._MAIL_RUN.finditer(text)]
