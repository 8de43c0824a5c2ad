import itertools
import random
import re

import pytest
import regex

from noteloom.llm import surrogates as su

R = su.Replacer(b"key")


def test_bijection_without_fixed_points():
    p = su.Permutation(b"k")
    for base, n in ((10, 1), (10, 3), (5, 2), (2, 5), (21, 2)):
        all_ = [list(x) for x in itertools.product(range(base), repeat=n)]
        out = [tuple(p("t", x, base)) for x in all_]
        assert len(set(out)) == len(all_) and all(tuple(a) != b for a, b in zip(all_, out, strict=True))


def test_kinds_keep_their_form():
    text = "Mail Ána.Lee-42@mail7.Example.com or +1 (017) 555-7713, 017-555-7713; 10.0.200.3, card 4111 1111 1111 1111, 123-45-6789, Mrs. Anna Berg, DE89 3704 0044 0532 0130 00. v1.2.3.4.5 42"
    out, found = su.replaced(text, R)
    assert [e["kind"] for e in found] == ["email", "phone", "phone", "ip", "card", "ssn", "name", "iban"]
    for e in found:
        old, new = text[e["start"] : e["end"]], e["surrogate"]
        assert old != new and regex.fullmatch(su.PATTERNS[e["kind"]], new)
        assert su.replaced(new, R)[1][0]["kind"] == e["kind"]
        if e["kind"] != "ip":
            assert re.sub(r"\d", "9", old).lower().translate({}) != "" and len(old) == len(new)
    assert re.sub(r"\D", "", found[1]["surrogate"])[1:] == re.sub(r"\D", "", found[2]["surrogate"])
    assert su.luhn(found[4]["surrogate"]) == 0
    assert found[6]["surrogate"].startswith("Mrs. ") and found[6]["surrogate"].endswith("g")
    assert out.endswith("v1.2.3.4.5 42")


def test_coreference_and_distinctness(spark):
    rows = [(k, f"x{k % 50}.y@Host{k % 3}.com and 4{k % 50:015d} at 10.1.2.{k % 50}", "s") for k in range(300)]
    rows += [(1000, None, "s"), (1001, "", "s"), (1001, "", "s"), (None, "a@b.cc", "s"), (1002, "w " * 100_000 + "a@b.cc", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities string")
    out = su.substitute(docs, b"k")
    assert out.count() == len(rows) and su.collisions(docs, out).count() == 0
    got = {r.doc_id: r for r in out.collect()}
    assert got[1000].text is None and got[1001].text == "" and got[1000].entities == []
    assert got[0].text == got[150].text and got[None].text in got[1002].text
    assert su.substitute(docs.limit(0), b"k").count() == 0


@pytest.mark.parametrize("number,kept", [("+34 612 345 678", "+34 "), ("+33 6 12 34 56 78", "+33 "), ("+49 30 1234567", "+49 "), ("+1 (017) 555-7713", "+1 ("), ("+358 40 1234567", "+358 "), ("030 1234567", "0")])
def test_phones_keep_the_country(number, kept):
    out, found = su.replaced(f"call {number} now", R)
    assert [e["kind"] for e in found] == ["phone"]
    new = found[0]["surrogate"]
    assert new.startswith(kept) and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", number) and new[len(kept) :] != number[len(kept) :]


@pytest.mark.parametrize("name", ["Mr. McDonald", "Mr. O'Brien", "Monsieur d'Arc", "Mr. Łukasz Nowak", "Госпожа Ёлкина", "Frau Anna-Lena von Müller", "Dr. John Q. Smith", "Mme Şeyma Çelik"])
def test_whole_names_are_replaced(name):
    out, found = su.replaced(f"I met {name}, yes", R)
    assert [(e["kind"], e["start"], e["end"]) for e in found] == [("name", 6, 6 + len(name))]
    title, _, rest = name.partition(" ")
    new = found[0]["surrogate"]
    assert new.startswith(title + " ") and len(new) == len(name)
    for a, b in zip(regex.split(r"[ '\-.]", rest), regex.split(r"[ '\-.]", new.partition(" ")[2]), strict=True):
        assert a == b if a[:1].islower() or not a else a != b
        assert [c.isupper() for c in a] == [c.isupper() for c in b]


def test_names_without_titles_follow_those_with():
    out, found = su.replaced("Smith said: Dr. John Smith met John Smith, not Smithers or john.", R)
    john, smith = R.word("John"), R.word("Smith")
    assert out == f"{smith} said: Dr. {john} {smith} met {john} {smith}, not Smithers or john."
    assert su.replaced("John Smith came.", R)[1] == []


def test_valid_ibans_stay_valid_and_distinct():
    rng, seen = random.Random(4), set()
    for _ in range(300):
        body = "".join(rng.choices("0123456789", k=18))
        check = f"{98 - su.iban_remainder('DE', '00', body):02d}"
        new = R.iban("DE" + check + body)
        assert su.iban_remainder(new[:2], new[2:4], new[4:]) == 1 and new[4:] != body
        seen.add(new)
    assert len(seen) == 300
    bad = R.iban("DE12 3704 0044 0532 0130 00")
    assert su.iban_remainder("DE", bad[2:4], bad[4:].replace(" ", "")) != 1


def test_addresses_of_both_kinds():
    out, found = su.replaced("at 2001:db8::ff00:42 and fe80:0:0:0:1:2:3:4, a::b::c, 12:30:45 std::map", R)
    assert [e["kind"] for e in found] == ["ipv6", "ipv6"]
    assert len({e["surrogate"] for e in found}) == 2 and all(regex.fullmatch(su.PATTERNS["ipv6"], e["surrogate"]) for e in found)


def test_query_takes_its_key_from_the_session(spark):
    from noteloom.llm import queries

    run = lambda: {(r.doc_id, r.text) for r in queries.op10_pii_surrogates(spark, "/root/testdata/sf0.001").collect()}
    spark.conf.set("spark.noteloom.pii.key", "one")
    first = run()
    assert first == run()
    spark.conf.set("spark.noteloom.pii.key", "two")
    assert first != run()
    spark.conf.unset("spark.noteloom.pii.key")
    plain = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for doc_id, text in first:
        want, found = su.replaced(plain[doc_id], su.Replacer(b"one"))
        assert text == want
        pieces, last = [], 0
        for e in found:  # the text outside of entities is as it was
            pieces += [plain[doc_id][last : e["start"]], e["surrogate"]]
            last = e["end"]
        assert text == "".join([*pieces, plain[doc_id][last:]])


@pytest.mark.parametrize("text,gone", [
    ("王伟@example.com", "王伟 王 伟 example"), ("Mr. 王伟 came, 王伟 left", "王伟"), ("MR. SMITH", "SMITH"), ("Mr.  Smith", "Smith"),
    ("Mr.\xa0Smith", "Smith"), ("Mr.\nSmith", "Smith"), ("Mr. A", " A"), ("call +٣٤ ٦١٢ ٣٤٥ ٦٧٨ now", "٦١٢ ٣٤٥ ٦٧٨"), ("Dr. محمد علي", "محمد علي"),
    ("२०१-५५५-०१९९", "२०१ ५५५ ०१९९"), ("ΆΝΝΑ@παράδειγμα.gr", "ΆΝΝΑ παράδειγμα"), ("Ms. Ng and Ng", "Ng"), ("Prof. J. R. Smith", "Smith J. R."),
    ("madame Curie and CURIE", "Curie CURIE"), ("Mr.İnce and ß@straße.de", "İnce straße"),
])
def test_nothing_readable_stays_whatever_the_script(text, gone):
    out, found = su.replaced(text, R)
    assert found and not [w for w in gone.split() if w in out], out
    pieces, last = [], 0
    for e in found:
        pieces += [text[last : e["start"]], e["surrogate"]]
        last = e["end"]
    assert out == "".join([*pieces, text[last:]])


@pytest.mark.parametrize("text,kept", [
    ("Mr. Will will go. Will you?", " will go. Will you?"), ("Mr. May in May", " in May"), ("MS Windows, ms Word, I miss Paris, DR Congo", "MS Windows, ms Word, I miss Paris, DR Congo"),
    ("Dr\nThe next", "Dr\nThe next"), ("Dr. I saw", "Dr. I saw"), ("Mr. Smith\nThe next", "\nThe next"), ("Ms. An, An apple, an egg", ", An apple, an egg"),
])
def test_common_words_stay(text, kept):
    assert su.replaced(text, R)[0].endswith(kept)


def test_common_words_beside_a_name_are_names():
    will, smith = R.word("Will"), R.word("Smith")
    assert su.replaced("Dr. Will Smith met Will Smith. Will he?", R)[0] == f"Dr. {will} {smith} met {will} {smith}. Will he?"


def test_listed_names_keep_gender_and_length_and_are_one_to_one():
    for kind, names in su.NAMES.items():
        names = set(names.split())
        for name in names:
            new = R.word(name)
            assert new != name and len(new) == len(name) and new[0].isupper() and R.word(name.upper()) == new.upper()
            if name.lower() in R.listed:
                assert new in names or sum(name in x.split() for x in su.NAMES.values()) > 1, (kind, name, new)
    rng = random.Random(2)
    words = {"".join(rng.choices("abcdehilmnorstuy", k=rng.randint(2, 6))).capitalize() for _ in range(3000)} | {n for x in su.NAMES.values() for n in x.split()}
    new = {w: R.word(w) for w in words}
    assert len(set(new.values())) == len(words) and all(a != b for a, b in new.items())
    assert su.Replacer(b"other").listed != R.listed


def test_collisions_query(spark):
    from noteloom.llm import queries

    assert queries.surrogate_collisions(spark, "/root/testdata/sf0.001").count() == 0
    assert {r.keyed for r in queries.op10_pii_surrogates(spark, "/root/testdata/sf0.001").select("keyed").collect()} == {False}
