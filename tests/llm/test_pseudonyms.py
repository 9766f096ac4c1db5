"""Finding and refilling of personal values over generated spellings, against a plain model."""

import datetime
import hashlib
import random
import re

import pytest

from phyllo.llm import pii
from phyllo.llm.pii import Pseudonyms

R = random.Random(11)
DIGITS = lambda n: "".join(R.choice("0123456789") for _ in range(n))


def _shape(text):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", text)))


def _phones():
    for _ in range(60):
        a, b, c = DIGITS(3), DIGITS(3), DIGITS(4)
        yield [f"+1{a}{b}{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+1.{a}.{b}.{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1{a} {b} {c}"]
    for code in ("44", "49", "33", "353", "420", "7", "86"):
        for _ in range(10):
            a, b, c = DIGITS(3), DIGITS(4), DIGITS(3)
            yield [f"+{code}{a}{b}{c}", f"+{code} {a} {b} {c}", f"+{code}-{a}-{b}-{c}", f"+{code} ({a}) {b} {c}"]


def test_every_spelling_of_a_phone_number_is_replaced_alike():
    change, seen = Pseudonyms(b"tests"), {}
    for forms in _phones():
        news = set()
        for form in forms:
            text, counts = change.replace(f"call {form}, please")
            assert counts == {"phone": 1} and _shape(text) == _shape(f"call {form}, please"), form
            digits = re.sub(r"\D", "", text)
            news.add(digits if form[0] == "+" else "1" + digits)
        assert len(news) == 1
        number = re.sub(r"\D", "", forms[0])
        assert seen.setdefault(news.pop(), number) == number  # different numbers stay different


def test_dates_keep_their_width_and_stay_linked():
    change = Pseudonyms(b"tests")
    for _ in range(400):
        day = datetime.date.fromordinal(R.randrange(pii.FIRST_DAY.toordinal(), pii.LAST_DAY.toordinal() + 1))
        y, m, d = day.year, day.month, day.day
        forms = [f"{y:04d}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d}/{m}/{y}", f"{d:02d}-{m}-{y}"]
        news = set()
        for form in forms:
            text, counts = change.replace(form)
            assert counts == {"date": 1} and _shape(text) == _shape(form)
            parts = [int(x) for x in re.split(r"\D", text)]
            news.add(datetime.date(*(parts if len(text.split("-")[0]) == 4 else parts[::-1])))
        assert len(news) == 1
    days = {datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(800)}
    assert len({change.replace(d.isoformat())[0] for d in days}) == len(days)
    assert change.replace("1899-12-31 2100-01-01 2023-02-29") == ("1899-12-31 2100-01-01 2023-02-29", {})


@pytest.mark.parametrize("kind", ["card", "ssn", "ip", "iban"])
def test_valid_values_become_other_valid_values(kind):
    change, seen = Pseudonyms(b"tests"), {}
    for _ in range(150):
        if kind == "card":
            body = DIGITS(15)
            plain = body + str(pii.luhn_digit(body))
            forms = [plain, " ".join(plain[i : i + 4] for i in range(0, 16, 4)), "-".join(plain[i : i + 4] for i in range(0, 16, 4))]
        elif kind == "ssn":
            forms = [f"{R.choice([*range(1, 666), *range(667, 900)]):03d}-{R.randint(1, 99):02d}-{R.randint(1, 9999):04d}"]
        elif kind == "ip":
            forms = [".".join(str(R.randrange(256)) for _ in range(4))]
        else:
            body = "".join(R.choice("ABCDEFGHIJ0123456789") for _ in range(R.choice([12, 16, 18])))
            plain = f"GB{98 - pii._iban_rest('GB00' + body):02d}{body}"
            forms = [plain, " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))]
        news = set()
        for form in forms:
            text, counts = change.replace(f"<{form}>")
            assert counts == {kind: 1}
            if kind != "ip":
                assert _shape(text) == _shape(f"<{form}>")
            assert change.replace(text)[1] == counts  # valid again
            news.add(re.sub(r"[ <>-]", "", text) if kind != "ip" else text)
        assert len(news) == 1
        value = re.sub(r"[ -]", "", forms[0])
        assert seen.setdefault(news.pop(), value) == value


def test_what_fails_its_check_stays():
    change = Pseudonyms(b"tests")
    for _ in range(100):
        body = DIGITS(15)
        wrong = body + str((pii.luhn_digit(body) + R.randint(1, 9)) % 10)
        assert change.replace(f"no {wrong}.")[0] == f"no {wrong}."
    for text in ("300.1.2.3", "01.2.3.4", "666-12-3456", "900-12-3456", "123-00-4567", "GB00WEST12345698765432", "31/02/2020", "v1.2.3", "+1234"):
        assert change.replace(text) == (text, {})


def test_long_texts_and_the_key_of_the_session(spark):
    long = "words +1 555 123 4567 and more. " * 20_000
    df = spark.createDataFrame([(1, long), (2, "+15551234567"), (3, None), (4, "")], "doc_id long, text string").withColumn("n_pii", df_lit())
    rows = {r["doc_id"]: r for r in pii.pseudonymise(df, b"tests").collect()}
    assert rows[1]["n_phone"] == 20_000 and len(rows[1]["text"]) == len(long) and rows[4]["text"] == "" and rows[3]["text"] is None and rows[4]["n_pii"] == 0
    assert re.sub(r"\D", "", rows[1]["text"][:28]) == rows[2]["text"][1:]
    spark.conf.set(pii.KEY_SETTING, "another key " * 20)
    try:
        other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df).collect()}
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert other[2] != rows[2]["text"] and other[2] == Pseudonyms(("another key " * 20).encode()).replace("+15551234567")[0]


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_mail_addresses_link_whatever_their_case():
    s = Pseudonyms(b"tests")
    one, other, third = (s.replace(t)[0] for t in ("Mia.Roy7@Mail-Host.example.org", "mia.roy7@mail-host.EXAMPLE.org", "zoe@mail-host.example.org"))
    assert one.lower() == other.lower() and one != other and one[0].isupper() and one.endswith(".org")
    assert "mail-host" not in one.lower() and "example" not in one.lower()
    assert third.partition("@")[2] == other.partition("@")[2].lower()


def test_no_key_no_pseudonyms(spark):
    with pytest.raises(ValueError, match="secret"):
        pii.pseudonymise(spark.createDataFrame([(1, "a@b.example")], "doc_id long, text string"))


def _plain_feistel(key, value, bound, tweak):
    """The permutation written out: an a x b grid over the bound, ten keyed rounds in turn on row and column, on while outside."""
    a = next(x for x in range(max(1, int(bound**0.5) - 2), bound + 1) if x * x >= bound)
    b = -(-bound // a)
    while True:
        at = [value // b, value % b]
        for step in range(10):
            side = step % 2
            seen = at[1 - side]
            said = bytes([step]) + len(tweak).to_bytes(2, "big") + tweak + seen.to_bytes(max(1, -(-seen.bit_length() // 8)), "big")
            at[side] = (at[side] + int(hashlib.blake2b(said, key=key, digest_size=32).hexdigest(), 16)) % (a, b)[side]
        value = at[0] * b + at[1]
        if value < bound:
            return value


def test_op10_equals_a_plain_version(spark, sf):
    """The query against texts gone through one by one: what it replaces, with what, and that nothing else changes."""
    feistel = pii.Feistel(b"k")
    for bound in (2, 7, 90, 365, 1000):
        assert [feistel(v, bound, b"t") for v in range(bound)] == [_plain_feistel(b"k", v, bound, b"t") for v in range(bound)]
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r["doc_id"]: r for r in pii.op10_feistel_pii(spark, sf).collect()}
    forward, backward = {}, {}
    mail, phone = re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}(?!\w)")
    kept = lambda c: c if not c.isalnum() else "x"
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        old, r = row["text"] or "", got[row["doc_id"]]
        new = r["text"] or ""
        if not r["n_pii"]:
            assert old == new
        mails, phones = mail.findall(old), phone.findall(old)
        assert r["n_email"] == len(mails) and r["n_phone"] >= len(phones)
        pairs = [*zip(mails, mail.findall(new), strict=True), *zip(phones, phone.findall(new), strict=True)]
        for a, b in pairs:
            assert a != b and [*map(kept, a)] == [*map(kept, b)]
            assert forward.setdefault(a, b) == b and backward.setdefault(b, a) == a
        if r["n_ip"] == 0:
            assert [*map(kept, old)] == [*map(kept, new)]
        assert r["text_sha256"] == hashlib.sha256(new.encode()).hexdigest()
    assert len(forward) > 10
    for a, b in forward.items():
        if a[0] == "+":
            digits = re.sub(r"\D", "", a)[1:]
            assert re.sub(r"\D", "", b) == "1" + str(_plain_feistel(pii.QUERY_KEY, int(digits), 10**10, b"phone110")).zfill(10)
