"""Values in a credential context, to their real end."""

from weftline.llm import secrets


def test_partly_covered_values():
    text = 'password = "abcdefgh12!Zx9#Qw7" rest'
    assert secrets.find_spans(text) == [(0, 22, "assign"), (12, 30, "guess")]
    assert secrets.redacted(text) == '[assign]" rest'
    assert secrets.find_spans('password = "abcdefgh12"') == [(0, 22, "assign")]


def test_values_to_their_end():
    long = "".join("Zx9Qw7Rt"[i * i % 8] + chr(97 + i * 7 % 26) for i in range(300))
    for text, value in [
        (f'private_key = "{long}" rest', long),
        (f"auth: {long} rest", long),
        (f"auth => '{long}' rest", long),
        ('passphrase = "four random words here" rest', "four random words here"),
        ('pwd: "aB3$ x\\"Yz9!q" rest', 'aB3$ x\\"Yz9!q'),
        (f'auth: "{long} rest', long),
    ]:
        assert [text[s:e] for s, e, k in secrets.find_spans(text) if k == "guess"] == [value], text
        assert value not in secrets.redacted(text) and secrets.redacted(text).endswith("rest")
    assert secrets.find_spans("auth: " + "z" * 50_000) == secrets.find_spans("pwd: " + "yz" * 20_000) == []


def test_early_end_is_exact():
    import random

    gen = random.Random(2)
    parts = ["password", "monkey", "1999-12-31", "sdfghj", "zzzz", "ab", "x", "7", "Q!", "abcabcabc", "12", "qwerty"]
    for _ in range(3000):
        value = "".join(gen.choices(parts, k=gen.randint(1, 8)))
        assert (secrets.guess_cost(value)[0] >= 10) == (secrets.guess_cost(value, 10.0)[0] >= 10), value


def test_clean_sentences():
    for text in ["password is required", "the token is invalid.", "the secret is patience", "your password is incorrect", "auth: disabled", "credentials: optional", "The secret is \"out of the bag\" now"]:
        assert secrets.find_spans(text) == [] and secrets.redacted(text) == text, text
    for value in ["kqzvxwjp", "Tr0ub4dor&3xQz!", "correcthorsebatterystaple"]:
        assert [k for _, _, k in secrets.find_spans(f"the passphrase is {value}")] == ["guess"], value
