"""Name-literal pairs and propagated constants of the secret lexer."""

import time

import pytest

from ledgerleaf.llm.secrets import Lexer, Scanner

SECRET = "Zx9!qLw82#pTr"


def found(text):
    return sorted(text[s:e] for s, e in Lexer().secrets(text))


@pytest.mark.parametrize("line", [
    f'db_password: str = "{SECRET}"', f'const apiSecret: string = "{SECRET}";', f'let token: &\'static str = "{SECRET}";',
    f'password: Optional[SecretStr] = "{SECRET}"', f"authToken: string | null = '{SECRET}'", f'private_key:str="{SECRET}"',
    f'password{" " * 150}= "{SECRET}"', f'password{" " * 100_000}= "{SECRET}"', f'{"x" * 400}_password = "{SECRET}"',
    f"config['password'] = '{SECRET}'", f'{{"client_secret": "{SECRET}"}}', f"secret => '{SECRET}'", f"session_token := {SECRET}"])
def test_names_reach_their_literal(line):
    assert found(line) == [SECRET]


@pytest.mark.parametrize("line", [
    f'db_password_file: str = "{SECRET}"', f'colour: str = "{SECRET}"', 'password: SecretString = "changeme-please"',
    f'password:\n{" " * 8}= "{SECRET}"', f'password = read("{SECRET}")', f'password == "{SECRET}"'])
def test_harmless_names_and_values(line):
    assert found(line) == []


def test_constants_are_propagated():
    assert found(f'a = "{SECRET}"\nb = a\npassword = b') == [SECRET]
    assert found('a = "Zx9!qLw"\nb = "82#pTr"\npassword = a + b') == ["82#pTr", "Zx9!qLw"]
    assert found(f'k = "{SECRET}"\nk = k + k\nk = k + k\npassword = "${{k}}"\ntoken = k') == [SECRET]
    assert found(f'a = "{SECRET}"\na = "short"\npassword = a') == []


def test_doubling_chains_stay_small():
    lines = [f'a0 = "{SECRET}"'] + [f"a{i} = a{i - 1} + a{i - 1}" for i in range(1, 1000)]
    begun = time.process_time()
    assert found("\n".join([*lines, "password = a999"])) == [SECRET]
    assert found("\n".join([f'k = "{SECRET}"'] + ["k = k + k"] * 1000 + ["password = k"])) == [SECRET]
    assert time.process_time() - begun < 1


def test_long_chains_and_lines_take_time_in_proportion():
    growing = "\n".join([f'password0 = "{SECRET}0"'] + [f'password{i} = password{i - 1} + "{SECRET}{i}"' for i in range(1, 5000)])
    begun = time.process_time()
    assert len(found(growing)) == 5000
    for text in ("=" * 200_000, "a=" * 100_000, 'x="' * 60_000, "a:b " * 100_000, "word." * 100_000 + " =", ": a[" * 50_000,
                 "b: c | d " * 40_000, " " * 300_000 + "="):
        Lexer().secrets(text)
    assert time.process_time() - begun < 20


def test_base_spans_and_literals_together():
    scanner = Scanner()
    text = f'password = "{SECRET}"\nAKIA{"A1" * 8} {"0f" * 16} pass_phrase: str = "{SECRET}"'
    base = scanner.base(text)
    assert [k for _, k, _ in base] == [1, 2] and [text[s:e] for s, _, e in scanner.literals(text, base)] == [SECRET] * 2
