import datetime
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm.pii import KINDS, Permutation, Pseudonyms, iban_check, luhn_digit, op6_pseudonyms, pseudonymize

from .fixtures import documents, frame, write_tables

KEY = b"k1"


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 10**18), st.integers(0, 10**18), st.binary(min_size=1, max_size=8))
def test_permutations_invert(size, x, key):
    p = Permutation(key, "t", size)
    x %= size
    assert 0 <= p(x) < size and p(p(x), back=True) == x


def test_small_sets_are_permuted():
    for size in (1, 2, 7, 100, 367):
        p = Permutation(KEY, "t", size)
        assert sorted(map(p, range(size))) == list(range(size))


VALUES = {
    "card": ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "378282246310005"],
    "ssn": ["123-45-6789", "899-99-9999", "001-01-0001"],
    "ipv4": ["10.0.0.255", "255.255.255.255", "0.0.0.0"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["1999-12-31", "2/3/2004", "31.12.1987", "2020/02/29", "01-02-1950"],
    "phone": ["+1 (098) 555-0174", "(212) 555-0100", "+44 20 7946 0958", "212-555-0100"],
    "email": ["jane.doe42@example.com", "A_b+c@mail.example.org"],
}
LEFT = ["4111111111111112", "000-12-3456", "666-12-3456", "256.1.1.1", "DE88370400440532013000", "2021-02-29", "1899-12-31", "version 1.2.3", "12345", "no@host"]


def test_values_keep_their_format_and_are_valid():
    names, other = Pseudonyms(KEY), Pseudonyms(b"k2")
    for kind, values in VALUES.items():
        for v in values:
            text, found = names.replace(f"x {v}, y")
            assert found == [kind], v
            new = text[2:-3]
            assert text.startswith("x ") and text.endswith(", y") and new != v
            assert other.replace(v)[0] != new
            # What was found is found again, of the same kind.
            assert names.replace(new)[1] == [kind], (v, new)
            if kind in ("card", "ssn", "phone"):
                assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", v)
            if kind == "email":
                assert new.partition("@")[2] == v.partition("@")[2] and len(new) == len(v)
            if kind == "iban":
                plain = new.replace(" ", "")
                assert int(plain[2:4]) == iban_check(plain[:2], plain[4:]) and new[:2] == v[:2]
            if kind == "card":
                digits = re.sub(r"\D", "", new)
                assert luhn_digit(digits[:-1]) == int(digits[-1])
    for v in LEFT:
        assert names.replace(v) == (v, [])


def test_spellings_stay_linked():
    names = Pseudonyms(KEY)
    bare = lambda v: re.sub(r"\W", "", names.replace(v)[0])
    assert bare("4111111111111111") == bare("4111-1111-1111-1111") == bare("4111 1111 1111 1111")
    assert names.replace("1999-12-31")[0] == names.replace("1999/12/31")[0].replace("/", "-")
    assert names.replace("Jane@x.org")[0].lower() == names.replace("jane@x.org")[0]


def test_digit_kinds_invert():
    rng = random.Random(1)
    names, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    for _ in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = body + str(luhn_digit(body))
        assert back.replace(names.replace(card)[0])[0] == card


def test_query(spark, tmp_path):
    rows = [*documents(5, 25), (900, "mail a.b@c.org, card 4111111111111111 on 2020-01-02", "x"), (901, "card 4111 1111 1111 1111", "x")]
    folder = write_tables(spark, tmp_path, documents=frame(spark, rows, extra=True))
    got = op6_pseudonyms(spark, folder).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[900].n_found == 3 and by[900].n_card == by[900].n_email == by[900].n_date == 1
    assert "4111" not in by[900].text and "a.b@" not in by[900].text
    assert by[901].text[5:].replace(" ", "") in by[900].text
    assert by[300].text is None and by[301].text == ""
    names = Pseudonyms(b"a key for tests; give your own")
    assert sorted((str(i), t if t is None else names.replace(t)[0]) for i, t, _ in rows if i != 300) == sorted((str(r.doc_id), r.text) for r in got if r.doc_id != 300)
    assert all(r.n_found == sum(r[f"n_{k}"] for k in KINDS) for r in got)
    assert pseudonymize(frame(spark, []), KEY).collect() == []


def naive_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def naive_iban(text):
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_query_against_plain_rules(spark, tmp_path):
    """Validity, places, links and distinctness by rules that are written out here."""
    rng = random.Random(8)
    cards = [next(c for d in range(10) if naive_luhn(c := body + str(d))) for body in ("4" + "".join(rng.choice("0123456789") for _ in range(14)) for _ in range(60))]
    ibans = [next(c for k in range(2, 99) if naive_iban(c := f"DE{k:02d}{body}")) for body in ("".join(rng.choice("0123456789") for _ in range(18)) for _ in range(60))]
    dates = [f"{rng.randrange(1930, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(60)]
    rows, given = [], {}
    for i in range(150):
        card, iban, date = rng.choice(cards), rng.choice(ibans), rng.choice(dates)
        wrong = card[:-1] + str((int(card[-1]) + 1) % 10)
        given[i] = card, iban, date, wrong
        rows.append((i, f"pay {card} by {date}, from {iban}; not {wrong} or 2021-13-45.", "s"))
    folder = write_tables(spark, tmp_path, documents=frame(spark, rows))
    new = {}
    for r in op6_pseudonyms(spark, folder).collect():
        card, iban, date, wrong = given[r.doc_id]
        found = re.fullmatch(rf"pay (\d{{16}}) by (\d{{4}}-\d\d-\d\d), from (DE\d{{20}}); not {wrong} or 2021-13-45\.", r.text)
        assert found and r.n_found == 3
        a, b, c = found.groups()
        assert naive_luhn(a) and naive_iban(c) and datetime.date.fromisoformat(b)
        for kind, old, x in (("card", card, a), ("date", date, b), ("iban", iban, c)):
            # Equal values have equal pseudonyms, in all documents.
            assert new.setdefault((kind, old), x) == x
    assert len(set(new.values())) == len(new)
    assert sum(old != x for (_, old), x in new.items()) > 0.95 * len(new)
