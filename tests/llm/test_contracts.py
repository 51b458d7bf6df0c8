"""Queries on rows of their own against a plain reading of their contracts."""

import hashlib
import re

from caselog.llm.queries import ENTRIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(match):
    return re.sub("[^0-9]", "", match[0])


def luhn(number):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(number))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def personal_data(text):
    """n_email, n_ip, n_card, n_phone and the hash of the listing."""
    found = [
        [m for m in EMAIL.finditer(text)],
        [m for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))],
        [m for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]]
    spans = sorted((m.start(), k, m.end()) for k, own in enumerate(found) for m in own)
    listing = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in spans)
    return (*map(len, found), hashlib.sha256(listing.encode()).hexdigest())


def test_personal_data_is_counted_by_kind(spark, tmp_path):
    texts = [
        None, "", "nothing here", "10.0.0.1 then 10.0.0.2", "4111 1111 1111 1111", "+49 170 1234567 or a.b@c.de",
        "\U0001f600 x@y.org, 300.1.1.1, 192.168.0.255 and x@y.org again; +1 (212) 555-0100; 5500-0000-0000-0004",
        "4111111111111111 4111111111111111", "a@b.c@d.ef @g.h i@j 1.2.3.4.5.6.7.8", "0800.1.1.1 +12345 1234567890123456"]
    rows = [(i if i != 3 else None, t, "en", "s", 0) for i, t in enumerate(texts)] + [(4, texts[6], "en", "s", 0), (5, texts[5], "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = ENTRIES["op8_disclosing_terms"][0](spark, str(tmp_path)).collect()
    got = [(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found]
    assert sorted(got, key=repr) == sorted([(i, *personal_data(t or "")) for i, t, *_ in rows], key=repr)
