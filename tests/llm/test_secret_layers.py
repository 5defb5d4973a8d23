"""Secrets in repeated, wrapped, odd and oversized layers."""

import base64
import gzip

import pytest
from test_llm_operators import KEY, WRAPS

from heronry.llm import secrets


def found(text, kind):
    return [(a, b) for k, a, b in secrets.spans(text)[1] if k == kind]


def test_repeated_lines():
    line = "token%3Dabcdefghijklmn"
    assert found(f"{line}\n{line}", "assign") == [(0, 22), (23, 45)]


@pytest.mark.parametrize("wrap", WRAPS)
def test_repeated_runs(wrap):
    run = WRAPS[wrap](f"see {KEY}, ok")
    places = found(f"{run} and\n{run}", "access")
    assert {a < len(run) for a, _ in places} == {True, False}


@pytest.mark.parametrize("odd", ["\u00a0", "\ufeff", "\u200b", "\u200d", "\u00ad", "\f", "\0"])
@pytest.mark.parametrize("wrap", WRAPS)
def test_odd_characters(wrap, odd):
    assert found(f"x {WRAPS[wrap](f'a{odd}b {KEY} c')} y", "access")


@pytest.mark.parametrize("before", ["", "data: ", "-----BEGIN CERTIFICATE-----\n", "averylongwordinfront\n"])
@pytest.mark.parametrize("after", ["", "\n-----END", "\nNext words", " tail"])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_wrapped_base64(pack, newline, after, before):
    prose = " ".join(f"word{i * i % 97}" for i in range(60))
    data = base64.b64encode(pack(f"{'x' * (48 - 4)} {KEY}, {prose}".encode())).decode()  # across the first 57 bytes
    text = before + newline.join(data[i : i + 76] for i in range(0, len(data), 76)) + after
    start = len(before)
    assert any(a <= start + 60 and b >= start + 90 for a, b in found(text, "access"))


def test_oversized_layers(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_UNPACKED", 1000)
    for at in (0, 490, 995, 1500, 5000, 9980):
        body = "é" * (at // 2) + f" {KEY} " + "z" * (10_000 - at)
        assert found(base64.b64encode(gzip.compress(body.encode())).decode(), "access")
    twice = gzip.compress(b"first") + gzip.compress(KEY.encode())
    assert found(base64.b64encode(twice).decode(), "access")


@pytest.mark.parametrize("name", ["latin-1", "utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_other_encodings(name, pack):
    if pack is gzip.compress and name != "latin-1":
        pytest.skip("compressed text is UTF-8 or Latin-1")
    run = base64.b64encode(pack(f"le café, l'été: {KEY} voilà".encode(name))).decode()
    assert found(f"x {run} y", "access") == [(2, 2 + len(run))]


def test_binary_is_no_text():
    assert secrets._text(bytes(range(128, 256)) * 4) is None


def test_long_lines():
    plain, secret = "minified();" * 300_000, "token%3Dabcdefghijklmn"
    text = f"{plain}{secret};{plain}%41"
    assert found(text, "assign") == [(len(plain), len(plain) + len(secret))]
    dense = "%61%62" * 200_000
    assert found(f"{dense} {secret}", "assign") == [(len(dense) + 1, len(dense) + 1 + len(secret))]


def test_places_through_two_layers():
    """A URL layer within a Unicode one: each code point still comes from its own escape."""
    inner = "é token%3Dabcdefghijklmn é"
    text = "a " + "".join(f"\\u{ord(c):04x}" for c in inner) + " b"
    assert found(text, "assign") == [(2 + 6 * 2, 2 + 6 * (len(inner) - 2))]
