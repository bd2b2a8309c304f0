from hearthlog.llm import pii


def test_account_numbers_end_where_their_country_says(documents):
    bare, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [(f"pay {number}{rest}", 4, 4 + len(number)) for number in (bare, spaced, "GB82 WEST 1234 5698 7654 32", "NO9386011117947")
             for rest in ("", ".", " The rest", " Please", " 12 units", " AND MORE", f" {bare}")]
    wrong = ["pay DE89370400440532013001 The rest", "pay DE893704004405320130001", "pay DE89370400440532013000x"]
    docs = documents([(i, t[0]) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(wrong)])
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(docs)).collect()}
    for i, (text, start, end) in enumerate(texts):
        assert f"iban:{start}:{end}" in got[i]["spans"].split(","), text
        assert got[i]["n_iban"] == text[4:].count(bare) + (not text.startswith(f"pay {bare}")), text
    assert all(got[100 + i]["n_iban"] == 0 for i in range(len(wrong)))
