import re

import pytest

from coverlake.llm import surrogates as S

TEXT = ("Mail a.Bc+x@Mail7.example.com or A.BC+X@mail7.example.com, call +1 (017) 555-7713 or +1 017 555 7713, card 4111 1111 1111 1111 / 4845168114407329. "
        "IP 97.51.17.173. On 2020-01-02 Mr John Smith met Frau Anna Müller; SMITH left, Smith too. г-жа Анна Иванова. SSN 123-45-6789 "
        "IBAN DE89 3704 0044 0532 0130 00. version 1.2.3 and 12345")


def test_everything_is_found_and_gone():
    out = S.replace(TEXT, {})
    for part in ("Mail7", "555-7713", "4111", "4845168114407329", "97.51.17.173", "John", "Smith", "Müller", "Иванова", "123-45-6789", "3704"):
        assert part not in out
    for part in ("On 2020-01-02 Mr ", " met Frau ", "version 1.2.3 and 12345", "г-жа "):
        assert part in out


@pytest.mark.parametrize("phone", [
    "+14155551234", "+49 1701234567", "(415) 5551234", "(415)5551234", "0170 1234567", "+44 7911 123456", "0170/1234567", "030/123456-78", "01701234567",
    "+49/170/1234567", "+44 (0)20 7946 0958", "415-5551234", "415 555 1234", "+1.415.555.1234", "01 23 45 67 89", "+123 4567890 12345"])
def test_phone_formats(phone):
    for after in ("", ".", ", card 4111 1111 1111 1111", " 97.51.17.173", " SSN 123-45-6789"):
        text = f"Please call {phone}{after}"
        assert ("phone", 12, 12 + len(phone)) in S.detect(text)
        out = S.replace(text, {})
        new = out[12:12 + len(phone)]
        assert out.startswith("Please call ") and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", phone) and new != phone
        assert S.detect(new) == [("phone", 0, len(phone))]


def test_phone_spellings_agree_and_other_numbers_stay():
    for code, spellings in (("1", ("+14155551234", "+1 415 555 1234", "+1 (415) 555-1234")), ("49", ("+491701234567", "+49 1701234567", "+49 170/1234567"))):
        out = {re.sub(r"\D", "", S.replace(f"x {p} y", {})) for p in spellings}
        assert len(out) == 1 and out.pop().startswith(code)
    for text in ("on 12/31/2019 and 2019/12/31", "at 52.520008, 13.404954", "about 1234567 people", "in 2019 500000 people", "3.14159265"):
        assert S.replace(text, {}) == text


def test_type_and_format_stay():
    out = S.replace("card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (017) 555-7713, 97.51.17.173, SSN 123-45-6789", {})
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", out)
    assert [S.luhn(re.sub(r"\D", "", c)) == 0 for c in cards] == [True, False] and cards[0][0] == "4"
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out) and re.search(r"SSN \d{3}-\d{2}-\d{4}$", out) and S.IP.search(out)
    for value, letters in (("Иванова", "[а-я]+ва"), ("Smith", "[a-z]+r")):
        name = S.rendered("family_f" if letters[1] == "а" else "family_m", value, S.surrogate("family_f" if letters[1] == "а" else "family_m", value.casefold()))
        assert re.fullmatch(letters, name.lower()) and name[0].isupper()


def test_coreference():
    out = S.replace(TEXT, {})
    mails = re.findall(r"\S+@\S+\.example\b", out)
    assert len(mails) == 2 and len(set(mails)) == 1
    phones = [re.sub(r"\D", "", p) for p in re.findall(r"\+1 \(?\d{3}\)? \d{3}[ -]\d{4}", out)]
    assert len(phones) == 2 and len(set(phones)) == 1
    name = re.search(r"Mr (\w+) (\w+) met", out)[2]
    assert f"; {name.upper()} left, {name} too." in out


@pytest.mark.parametrize("digits", ["12", "123", "1234567", "0000000000", "999999999999999999"])
def test_permutation_keeps_length(digits):
    assert len(S.permute(digits, b"k", "t")) == len(digits)
    n = min(len(digits), 3)
    assert len({S.permute(str(k).zfill(n), b"k", "t") for k in range(10 ** n)}) == 10 ** n


def test_collisions_are_keyed_again(spark, monkeypatch):
    entities = spark.createDataFrame([("family_m", f"name{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(600)], "kind string, entity string")
    out = S.distinct_attempts(entities).collect()
    assert len(out) == 600 == len({r.surrogate for r in out})
    # entities that are the surrogates of others are keyed again, too
    taken = [("ssn", S.surrogate("ssn", str(k).zfill(9))) for k in range(20)] + [("ssn", str(k).zfill(9)) for k in range(20)]
    out = S.distinct_attempts(spark.createDataFrame(taken, "kind string, entity string")).collect()
    assert not {r.surrogate for r in out} & {r.entity for r in out} and len({r.surrogate for r in out}) == len(out)
    assert sum(r.attempt > 0 for r in out) >= 20


def test_attempts_reach_the_documents(spark):
    ssn = lambda x: f"{x[:3]}-{x[3:5]}-{x[5:]}"
    other = S.surrogate("ssn", "000000001")
    df = spark.createDataFrame([(1, f"x {ssn('000000001')} y"), (2, f"z {ssn(other)}"), (None, f"n {ssn('000000001')}")], "doc_id bigint, text string")
    out = {r.doc_id: r.text for r in S.replace_entities(df).collect()}
    assert ssn(other) not in "".join(out.values()) and out[1][2:13] == out[None][2:13] != out[2][2:13]


def test_frames(spark):
    rows = [(1, None, 1), (1, "a@b.cd", 2), (1, "a@b.cd", 2), (None, "", 3), (5, "x" * 200_000 + " a@b.cd", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, pii int").selectExpr("*", "1 as pii_id", "1 as kind", "2 as entity")
    out = S.replace_entities(df)
    assert out.columns == df.columns and sorted(r.pii for r in out.collect()) == [1, 2, 2, 3, 4]
    assert not [r for r in out.collect() if r.text and "a@b.cd" in r.text]
    assert S.replace_entities(df.limit(0)).count() == 0


def test_query_leaves_no_entity_and_other_words_as_they_are(spark):
    from tests.conftest import SF_SMALL
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    after = {r.doc_id: r.text for r in S.q_surrogates(spark, SF_SMALL).collect()}
    assert before.keys() == after.keys()
    pattern = re.compile(r"[\w.+-]+@[\w.-]+\.\w+|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|(?<!\w)\d{16}(?!\w)")
    real = {m for t in before.values() for m in pattern.findall(t or "")}
    assert real and not real & {m for t in after.values() for m in pattern.findall(t or "")}
    for d, t in before.items():
        assert pattern.sub("@", t) == pattern.sub("@", after[d])


def test_one_surrogate_for_a_name_of_several_genders(spark):
    rows = [(1, "Mr Smith came"), (2, "Dr Smith came"), (3, "Mrs Smith came"), (4, "Herr SMITH came"), (5, "г-н Иванов и"), (6, "Dr Иванов и")]
    out = {r.doc_id: r.text for r in S.replace_entities(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    name = re.match(r"Mr (\w+) came", out[1])[1]
    assert name != "Smith" and out[2] == f"Dr {name} came" and out[3] == f"Mrs {name} came" and out[4] == f"Herr {name.upper()} came"
    stems = {re.search(r"(?:г-н|Dr) (\w{4})", out[k])[1] for k in (5, 6)}
    assert len(stems) == 1


def test_genders_go_on_together(spark, monkeypatch):
    monkeypatch.setitem(S.SYLLABLES, "latin", ["ba", "be"])            # collisions for certain
    entities = [(f"family_{g}", f"name{k}") for k in range(40) for g in "mfn"]
    out = S.distinct_attempts(spark.createDataFrame(entities, "kind string, entity string")).collect()
    by_name, by_surrogate = {}, {}
    for r in out:
        by_name.setdefault(r.entity, set()).add((r.attempt, r.surrogate))
        by_surrogate.setdefault(r.surrogate, set()).add(r.entity)
    assert len(by_name) == 40 and all(len(x) == 1 for x in by_name.values()) and all(len(x) == 1 for x in by_surrogate.values())


def test_whole_names():
    out = S.replace("Mr Juan Carlos de la Cruz Ortega left. Herr Otto von Berg, Dr Anna Maria Luisa Rossi Bianchi spoke", {})
    for word in ("Juan", "Carlos", "Cruz", "Ortega", "Otto", "Berg", "Anna", "Maria", "Luisa", "Rossi", "Bianchi"):
        assert word not in out
    assert " de la " in out and " von " in out and out.endswith(" spoke") and " left. Herr " in out
    assert S.replace("Mr Smith met Mrs Jones", {}).split(" met ")[1].startswith("Mrs ") and "Jones" not in S.replace("Mr Smith Mrs Jones", {})


def test_iban_check_digits():
    for iban, valid in (("DE89370400440532013000", True), ("GB82WEST12345698765432", True), ("DE88370400440532013000", False)):
        assert (S.iban_rest(iban) == 1) == valid
        for attempt in range(20):
            new = S.surrogate("iban", iban, attempt)
            assert (S.iban_rest(new) == 1) == valid and new != iban
            assert new[:2] == iban[:2] and [c.isdigit() for c in new] == [c.isdigit() for c in iban]


def test_addresses_keep_their_block():
    import ipaddress
    for ip in ("10.1.2.3", "172.20.0.1", "192.168.1.1", "127.0.0.1", "169.254.7.7", "8.8.8.8", "97.51.17.173"):
        block = [n for n in S.BLOCKS if ipaddress.IPv4Address(ip) in n]
        for attempt in range(30):
            new = S.surrogate("ip", ip, attempt)
            assert [n for n in S.BLOCKS if ipaddress.IPv4Address(new) in n] == block
    assert len({S.surrogate("ip", f"192.168.3.{k}") for k in range(256)}) == 256
    text = "at 2001:db8::ff00:42:8329 and FE80:0:0:0:1:2:3:4, 12:34:56, a::b::c, ::1, std::vector"
    assert [text[a:b] for k, a, b in S.detect(text) if k == "ipv6"] == ["2001:db8::ff00:42:8329", "FE80:0:0:0:1:2:3:4"]
    out = S.replace(text, {})
    assert "42:8329" not in out and out.startswith("at 2001:") and " and fe80:" in out and out.endswith(", 12:34:56, a::b::c, ::1, std::vector")


@pytest.mark.parametrize("bits", [1, 2, 7, 8])
def test_bit_permutation(bits):
    assert len({S.permute_bits(x, bits, b"k", "t") for x in range(1 << bits)}) == 1 << bits


def test_distinctness_and_coreference_over_the_table(spark):
    """Brute force over whole documents: mentions of one entity get one surrogate, other entities others."""
    from tests.conftest import SF_MID
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {r.doc_id: r.text or "" for r in S.q_surrogates(spark, SF_MID).collect()}
    forward, back = {}, {}
    for d, text in before.items():
        found = S.detect(text)
        cuts = [0, *(x for _, a, b in found for x in (a, b)), len(text)]
        words = [re.escape(text[a:b]) for a, b in zip(cuts[::2], cuts[1::2])]
        new = re.fullmatch("(.+?)".join(words), after[d], re.S)
        assert new, d
        for (kind, a, b), shown in zip(found, new.groups()):
            space = kind.split("_")[0]
            mine = re.sub(r"\W", "", shown.casefold()) if space not in ("email", "ip", "ipv6") else shown
            forward.setdefault((space, S.canonical(kind, text[a:b])), set()).add(mine)
            back.setdefault((space, mine), set()).add(S.canonical(kind, text[a:b]))
    assert len(forward) > 50 and all(len(x) == 1 for x in forward.values()) and all(len(x) == 1 for x in back.values())
    assert not {m for (space, _), x in forward.items() for m in x if space in ("ip", "email")} & {e for _, e in forward}
