"""Deep nesting and runs over window borders of the secret scan."""

import base64
import gzip
import time

import pytest

from cairnwork.llm import secretscan


def spans(text):
    return {(a, b, k.split("/")[0]) for a, b, k in secretscan.finds(text)[1]}


def test_nested_escapes_of_any_depth():
    began = time.time()
    for text in ("password: %" + "25" * 10_000 + "41bcdefgh", "passwor\\" + "u005c" * 10_000 + "u0064=abcdefgh", "token=a&" + "#38;" * 10_000 + "#65;bcdefgh"):
        assert (0, len(text), "assign") in spans(text)
    assert time.time() - began < 3
    assert secretscan.finds("%" + "25" * 1000 + "41")[1] == []
    many = ("token=%" + "25" * 100 + "41bcdefghij some other words\n") * 500
    assert len(secretscan.finds(many)[1]) == 500


def test_alternating_layers_keep_their_places():
    d = "d"
    for k in range(200):
        d = "".join("%%%02x" % b for b in d[:1].encode()) + d[1:] if k % 2 else f"\\u{ord(d[0]):04x}" + d[1:]
    text = "é\nfirst line\npasswor" + d + "=abcdefgh\nlast line"
    assert (13, len(text) - 10, "assign") in spans(text)
    url = "x%C3%A9 passwor%2564=%2541bcdefgh%20 and %2520"
    assert spans(url) == {(8, url.index("%20 and"), "assign")}


def test_names_of_repeated_layers():
    inner = "token=abcdefgh"
    for _ in range(5):
        inner = base64.b64encode(("xx " + inner + " yy").encode()).decode()
    assert [k for _, _, k in secretscan.finds(inner)[1]] == ["assign/base64*5"]


@pytest.mark.parametrize("shift", range(4))
def test_runs_over_a_windows_border(monkeypatch, shift):
    monkeypatch.setattr(secretscan, "WINDOW", 1 << 14)
    monkeypatch.setattr(secretscan, "MOST_WINDOW", 3 << 14)
    monkeypatch.setattr(secretscan, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secretscan, "CHUNK", 1 << 12)
    secret = base64.b64encode(b"x " * 1500 + b" token=abcdefghijk " + b"y " * 1500).decode()
    for before in range((3 << 14) - len(secret) - 100, (3 << 14) + 100, 997):
        body = ("ab, " * (1 << 14))[: before + shift] + " " + secret + " " + "cd, " * 5000
        text = base64.b64encode(gzip.compress(body.encode())).decode()
        assert spans(text) == {(0, len(text), "assign")}


@pytest.mark.parametrize("lines", [False, True])
def test_runs_longer_than_a_window(monkeypatch, lines):
    monkeypatch.setattr(secretscan, "WINDOW", 1 << 14)
    monkeypatch.setattr(secretscan, "MOST_WINDOW", 3 << 14)
    monkeypatch.setattr(secretscan, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secretscan, "CHUNK", 1 << 12)
    for content in (b"q " * 70_000 + b" token=abcdefghijk " + b"y " * 100, gzip.compress(b"q " * 70_000 + b" token=abcdefghijk ") + b"\0" * 200_000):
        run = base64.b64encode(content).decode()
        if lines:
            run = "\n".join(run[i : i + 76] for i in range(0, len(run), 76))
        body = "data:\n" + run + "\n\n" + "ab, " * 9000 + " AKIA" + "Z" * 20
        text = base64.b64encode(gzip.compress(body.encode())).decode()
        assert spans(text) == {(0, len(text), "assign"), (0, len(text), "access")}
    key = "AKIA" + "Z" * 20 + "/"
    text = base64.b64encode(gzip.compress(("x " + key + "abcd" * 40_000).encode())).decode()
    assert (0, len(text), "access") in spans(text)


def test_a_find_that_begins_with_a_runs_last_word(monkeypatch):
    monkeypatch.setattr(secretscan, "WINDOW", 1 << 14)
    monkeypatch.setattr(secretscan, "MOST_WINDOW", 3 << 14)
    for between in ("", "\n"):
        body = "x " + ("z" * 75 + between) * 2000 + 'token = "abcdefgh"'
        text = base64.b64encode(gzip.compress(body.encode())).decode()
        assert spans(text) == {(0, len(text), "assign")}
