import pytest

from loomgraph.llm.pii import Pseudonyms

KEY = b"k1"
CARD, IBAN = "4111111111111111", "DE89370400440532013000"


@pytest.mark.parametrize(
    ("text", "value", "kind"),
    [
        (f"{IBAN} BIC", IBAN, "iban"),
        ("pay DE89 3704 0044 0532 0130 00 EUR 100", "DE89 3704 0044 0532 0130 00", "iban"),
        ("AB12 DE89 3704 0044 0532 0130 00 today", "DE89 3704 0044 0532 0130 00", "iban"),
        (f"{CARD} 12/27", CARD, "card"),
        ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
        ("4111-1111-1111-1111 12, x", "4111-1111-1111-1111", "card"),
        ("no 12 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ],
)
def test_values_with_groups_beside_them(text, value, kind):
    names = Pseudonyms(KEY)
    new, found = names.replace(text)
    before, _, after = text.partition(value)
    assert found == [kind]
    assert new == before + names.replace(value)[0] + after and value not in new


def test_the_search_goes_on_behind_the_accepted_part():
    new, found = Pseudonyms(KEY).replace(f"{IBAN} GB82 WEST 1234 5698 7654 32 {CARD} 5500 0000 0000 0004")
    assert found == ["iban", "iban", "card", "card"]
    assert not any(v in new for v in (IBAN, "WEST", CARD, "5500 0000"))


def test_sizes():
    from loomgraph.llm.pii import IBAN_SIZES

    assert len(IBAN_SIZES) > 70 and IBAN_SIZES["DE"] == 22 and IBAN_SIZES["NO"] == 15 and IBAN_SIZES["LC"] == 32
