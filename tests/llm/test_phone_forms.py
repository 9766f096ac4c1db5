"""Phone numbers in compact and separated forms."""

import re

import pytest

from phyllo.llm.pii import Pseudonyms


@pytest.mark.parametrize(
    ("code", "forms"),
    [
        ("1", ["+15551234567", "+1555-123-4567", "+1 (555) 123-4567", "+1-555-123-4567"]),
        ("44", ["+442079460958", "+44 20 7946 0958", "+4420-7946-0958"]),
        ("353", ["+35312345678", "+353 1 234 5678"]),
        ("7", ["+74951234567", "+7 495 123 4567"]),
    ],
)
def test_forms_of_a_phone_number_get_one_pseudonym(code, forms):
    change = Pseudonyms(b"tests")
    got = [change.replace(f"call {f} now") for f in forms]
    assert all(counts == {"phone": 1} and form not in text for form, (text, counts) in zip(forms, got, strict=True))
    digits = {re.sub(r"\D", "", text) for text, _ in got}
    assert len(digits) == 1 and digits.pop().startswith(code)
