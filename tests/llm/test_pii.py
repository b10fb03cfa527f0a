import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sitewise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.op2(spark, docs).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        spans = brute(t)
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert (rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone) == tuple(sum(s[2] == k for s in spans) for k in PATTERNS), t
        assert rows[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [s for s in rows[i].spans.split(",") if s and not s.startswith("term:")] == [s for s in said.split(",") if s]
    return rows


HARD = [
    "a@b.c_x@y.z q@w.ee", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 00000000000000000000255.1.1.1", "4111 1111 1111 1111 4111111111111111 1 2 3 4 5 6",
    "+1 (555) 010-9999. +12 +1234567890123456 +49 170 1234567 +49 170 1234567", "x" * 5000 + "@" * 3 + "a@b@c.d ééé@é.fr é.x@y.de\x01\x02a@b.cc", None, "", "..@..-a.b user@-.--",
    "1-1-1-1-1-1-1-1-1-1-1-1-1-1", "12345678901.2.3.4 00001.002.3.4", "☃🙂 jane@ex.org 🙂 10.0.0.1", "9 " * 3000, "1" * 9000, "a." * 4000 + "@b.c", " ".join(f"u{i}@m.org" for i in range(300))]


def test_hard_texts(spark):
    check(spark, HARD)


def test_random_texts(spark):
    texts = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.text(alphabet="1409+-. ()@ab_é\n", max_size=60))
    def gather(t):
        texts.append(t)

    gather()
    check(spark, texts)


def test_disclosing_terms(spark):
    """A word that stands by one address only, in many documents, reveals it; a common word does not."""
    texts = [f"the project Zanzibar team is at secret@corp.org today number{i}" for i in range(6)]
    texts += [f"the project team is away today number{i} and nobody said anything of note" for i in range(60)]
    rows = check(spark, texts)
    for i in range(6):
        terms = [texts[i][int(a) : int(b)] for _, a, b in (s.split(":") for s in rows[i].spans.split(",")) if texts[i][int(a) : int(b)] != "secret@corp.org"]
        assert "Zanzibar" in terms and "project" not in terms and "today" not in terms
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs).collect()}
    assert "Zanzibar" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[10]


def test_terms_of_whole_documents(spark):
    """Names and codes far from an address are counted, and every place of them is masked; other documents keep theirs."""
    far = "and then some more was said of this and of that "
    texts = [f"Zanzibar QX7 {far * 4} {i} write to secret@corp.org {far * 4} 4111 1111 1111 1112 zanzibar. \u0130zmir-secret" for i in range(6)]
    texts += [f"{far} 4111 1111 {i + 6}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    for i in range(6):
        assert [texts[i][s.start : s.end] for s in found[i].added if s.share >= 0.95] == ["Zanzibar", "QX7", "write", "to", "1112", "zanzibar", "\u0130zmir", "secret"]
    assert not any(found[i].added for i in range(6, 66))
    clean = {r.doc_id: r.sanitised for r in pii.sanitise(docs).collect()}
    assert not re.search("zanzibar|QX7|\u0130zmir|secret", clean[0], re.I) and clean[20] == texts[20]


def test_terms_equal_brute_force(spark, documents):
    """Counts over whole documents, for any text and any mix of entities."""
    import math
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    texts = []
    for _ in range(120):
        k = rng.randrange(14)
        parts = [f"u{k}@m.io", *rng.choices([f"c{k}", f"c{k + 1}", "q"], [6, 1, 1], k=2), *rng.choices(["a@b.cc", "x@w1.yy", "10.0.0.7", "q"], k=2), *rng.choices(words, k=rng.randint(1, 30))]
        texts.append(" ".join(rng.sample(parts, len(parts))))
    found = {r.doc_id: r for r in pii.find_spans(documents(texts)).collect()}
    ents, terms = {}, {}
    for i, t in enumerate(texts):
        spans = sorted((s.start, s.end) for s in found[i].base)
        rest = "".join(" " if any(a <= k < b for a, b in spans) else ch for k, ch in enumerate(t))
        ents[i], terms[i] = {t[a:b] for a, b in spans}, rest
    n = len(texts)
    n_c = {c: sum(c in e for e in ents.values()) for c in set().union(*ents.values())}
    toks = {i: set(re.findall(r"\w+", r)) for i, r in terms.items()}
    want_any = 0
    for i in terms:
        want = []
        for m in re.finditer(r"\w+", terms[i]):
            n_t = sum(m[0] in x for x in toks.values())
            shares = [math.log2(n * n_ct / (n_c[c] * n_t)) / math.log2(n / n_c[c]) for c in ents[i] if (n_ct := sum(c in ents[j] and m[0] in toks[j] for j in toks)) >= 2]
            if shares and max(shares) >= 0.8:
                want.append((m.start(), m.end()))
        assert [(s.start, s.end) for s in found[i].added] == want
        want_any += len(want)
    assert want_any


def test_empty_table(spark, documents):
    assert pii.op2(spark, documents([])).count() == 0
    assert pii.sanitise(documents([None])).first().sanitised == ""


def test_main_path_is_native(spark, documents):
    plan = pii.find_spans(documents(["a@b.cc x"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_many_matches_take_time_in_proportion(spark):
    import time

    def seconds(n):
        docs = spark.createDataFrame([(1, " ".join(f"u{i}@m.org and 10.0.{i % 256}.{i // 256 % 256}" for i in range(n)))], "doc_id long, text string")
        at = time.time()
        r = pii.base_spans(docs).first()
        assert len(r.base) == 2 * n
        return time.time() - at

    seconds(100)
    assert seconds(16_000) < 6 * max(1.0, seconds(4_000))


def test_repeated_rows_and_null_ids(spark):
    text = "call +49 170 1234567 or write jane@ex.org"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "nothing")], "doc_id long, text string")
    got = pii.op2(spark, docs).collect()
    assert len(got) == 5 and sum(r.n_email for r in got) == sum(r.n_phone for r in got) == 3
    assert len({r.spans for r in got if r.n_email}) == 1
