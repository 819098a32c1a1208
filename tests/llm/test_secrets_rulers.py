"""Allow-list patterns on rulers: linear time, the same answers as the patterns they stand for."""

import itertools
import re
import subprocess
import sys

from meterlake.llm import secrets as S


def test_a_long_ruler_ends_in_time():
    # In a process of its own, as a match that backtracks can't be interrupted.
    code = "from meterlake.llm import secrets as S\nfor x in 'aA':\n    for c in '_-=/':\n        assert S.scan(x + c * 10_000 + '1')[1] == []"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)


def test_patterns_allow_what_they_did():
    plain = re.compile(r"[A-Za-z][a-z]*(?:[/_=-]+[A-Za-z]?[a-z]*)*"), re.compile(r"[A-Z]+(?:[/_=-]+[A-Z]*)*")
    for n in range(8):
        for run in map("".join, itertools.product("aA_1", repeat=n)):
            assert [bool(p.fullmatch(run)) for p in S.ALLOW[1:3]] == [bool(p.fullmatch(run)) for p in plain]
