import pytest
from helpers import rows

from tidegrain.llm import encoding as E

TEXTS = {
    "en": "I’d wait until the restock lands — the café crowd paid £{n} and “best offer” went to Müller for €{n}. It’s gone within {n} days – who knows.",
    "de": "Grüße aus der Börse – der Käufer möchte für {n} € eine größere Übersicht; Näheres später. Ärgerlich, die Prüfer fanden Öl.",
    "fr": "Bonjour à tous, l’acheteur réclame une preuve d’achat – à vérifier, paraît-il. Ça coûte {n} €, déjà très élevé. À noter : É unique.",
    "es": "¿Alguien más lo vio? La comisión se comió la ganancia: {n} €, según dicen. Así que esperaré; el número está aquí, mañana.",
    "pt": "NÃO é promoção: SÃO {n} cópias na vitrine, já sem o selo de proteção. Atenção: a coleção não está à venda, À VISTA {n} €.",
    "ja": "店頭メモ。ルーペで見ると{n}の横に小さな印刷抜けがあります。再販の噂が出てから問い合わせが急に増えました(要確認)。",
    "zh": "今日记录:背面左下角有轻微白边,评级恐怕到不了{n}分。补充一下,日文版走得快,英文版还没有跟上,仅供参考。",
}
CLEAN = [t.format(n=17 * k + 3) + f" {k}" for k in range(30) for t in TEXTS.values()]


class One:
    """The model on one text at a time."""

    def __init__(self, texts):
        self.model = E.Model(texts)

    def read(self, text):
        return self.model.read([text])[0]


@pytest.fixture(scope="module")
def model():
    return One(CLEAN)


def test_inverse_of_every_pair():
    for true, used, times in E.PAIRS:
        text = TEXTS["ja" if true in ("cp932", "euc_jp") else "zh" if true == "gb18030" else "de"].format(n=5)
        if true == "cp1252":
            text = TEXTS["fr"].format(n=5)
        bad = E.garble(text, true, used, times)
        if "�" not in bad and (true, used) not in (("gb18030", "cp932"), ("utf-8", "cp932"), ("utf-8", "gb18030"), ("cp932", "gb18030")):
            assert E.ungarble(bad, true, used, times) == text, (true, used)


def test_sound_texts_stay(model):
    for k in (101, 202):
        for t in TEXTS.values():
            assert model.read(t.format(n=k))[0] is False, t


@pytest.mark.parametrize("pair", [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("utf-8", "cp1252", 2), ("utf-8", "mac_roman", 1), ("utf-8", "cp437", 1), ("utf-8", "cp850", 1), ("utf-8", "cp1251", 1), ("cp1252", "mac_roman", 1)])
@pytest.mark.parametrize("lang", ["en", "de", "fr", "es", "pt"])
def test_round_trip(model, pair, lang):
    text = TEXTS[lang].format(n=77)
    damaged, states, restored, whole = model.read(E.garble(text, *pair))
    assert damaged and restored == text and whole, (states, restored)


@pytest.mark.parametrize("pair", [("utf-8", "cp1252", 1), ("utf-8", "latin-1", 1), ("euc_jp", "cp1252", 1)])
def test_round_trip_japanese(model, pair):
    text = TEXTS["ja"].format(n=77)
    assert model.read(E.garble(text, *pair))[2] == text


def test_partial_damage_and_entities(model):
    text, bad = TEXTS["en"].format(n=9), E.garble(TEXTS["de"].format(n=9), "utf-8", "cp1252")
    assert model.read(text + "\n" + bad)[2] == text + "\n" + TEXTS["de"].format(n=9)
    assert model.read("the grader&acirc;&euro;&trade;s label says no")[2] == "the grader’s label says no"


def test_lost_characters_are_found_not_restored(model):
    for lost in ("Gr��e aus der B�rse", "ルーペで見ると小さな印刷抜けがあります。\n????????"):
        damaged, states, restored, whole = model.read(lost)
        assert damaged and not whole and restored == lost


def test_quoted_characters_are_sound(model):
    for text in ("If you meet “Ã¼” in a seller name, the file was read with the wrong table – café and Müller are fine.", "The replacement sign “�” in the label column is printed.", "Old exports show “â€™” instead of an apostrophe."):
        assert model.read(text)[0] is False


WIDE = CLEAN + [f"{w}{k}枚、{v}の{u}です。" for k in range(12) for w in ("東京の店で", "日本から", "価格は") for v in ("カード", "箱", "新しいカード") for u in ("店", "価格", "日本語版")] + [f"{w}{k}张,{v}很好。" for k in range(12) for w in ("今天买了", "收到卡片") for v in ("价格", "卡片状态", "品相")]


@pytest.fixture(scope="module")
def wide():
    return One(WIDE)


@pytest.mark.parametrize("word, pair", [
    ("日本", ("gb18030", "cp1252", 1)), ("日本", ("cp932", "cp1252", 1)), ("日本", ("euc_jp", "latin-1", 1)), ("カード", ("gb18030", "cp1252", 1)), ("カード", ("cp932", "cp1252", 1)), ("カード", ("euc_jp", "cp1252", 1)),
    ("価格", ("euc_jp", "cp1252", 1)), ("卡片状态", ("gb18030", "latin-1", 1)), ("东", ("utf-8", "cp1252", 1)),
])
def test_short_eastern_words_in_a_sentence(wide, word, pair):
    """No length decides: a word of two characters is found and restored as a long text is."""
    text = "I’d wait for the {} print — the café crowd paid £5 for it in March."
    damaged, states, restored, whole = wide.read(text.format(E.garble(word, *pair)))
    assert damaged and restored == text.format(word), (states, restored)


def test_short_words_recall_and_exactness():
    """Held out: one short stretch per text is garbled by a pair that can write it; at least nine of ten are found and restored exactly."""
    import random

    model, r = E.Model(WIDE), random.Random(5)
    for pair in E.PAIRS:
        true, used, _ = pair
        if used in ("gb18030", "cp932") or true == "cp1252":
            continue  # lose bytes at the edges, or change a single letter
        rows_ = []
        for k in range(100, 160):
            t = r.choice([v for n, v in TEXTS.items() if (n == "zh") == (true == "gb18030") and (n in ("ja", "zh")) == (true != "utf-8")]).format(n=k)
            if true in ("cp932", "euc_jp") and not t.encode(true, "ignore").decode(true) == t:
                continue
            runs = [m for m in E._RUNS.finditer(t) if not m.group().isascii() and (true == "utf-8" or len(m.group()) > 1)]
            m = r.choice(runs)
            a, b = m.start(), min(m.end(), m.start() + r.choice((2, 3, 5)))
            bad = t[:a] + E.garble(t[a:b], *pair) + t[b:]
            if bad != t:
                rows_.append((t, bad))
        got = model.read([b for _, b in rows_])
        assert sum(g[0] for g in got) >= 0.9 * len(rows_) and sum(g[2] == t for g, (t, _) in zip(got, rows_)) >= 0.9 * len(rows_), pair
        assert all(g[2] == t for g, (t, _) in zip(got, rows_) if g[3] and g[0]), pair


def test_lossless_is_not_claimed_for_what_could_be_read_otherwise(wide):
    for word in ("东京卡片", "東京カード", "これはかなです"):
        for pair in E.PAIRS:
            text = f"Price list: {word} sold at 30 USD"
            try:
                bad = f"Price list: {E.garble(word.encode(pair[0]).decode(pair[0]), *pair)} sold at 30 USD"
            except UnicodeError:
                continue
            damaged, states, restored, whole = wide.read(bad)
            assert not (damaged and whole and restored != text), (word, pair, restored)


def test_batches_change_nothing(wide):
    bad = [E.garble(t, *p) for t in CLEAN[:14] for p in E.PAIRS[:4]]
    assert wide.model.read(bad) == [wide.model.read([t])[0] for t in bad]


def test_table_with_nulls_empty_long_and_repeated_texts(spark):
    bad = E.garble(TEXTS["fr"].format(n=4), "utf-8", "cp1252")
    data = [(i, t, "x") for i, t in enumerate([None, "", "plain", bad, bad, CLEAN[0] + "z" * 300_000, *CLEAN])]
    got = E.find_damage(spark.createDataFrame(data, "doc_id bigint, text string, states string")).where("damaged")
    assert [r[0] for r in rows(got.select("doc_id"))] == [3, 4]
    assert E.find_damage(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def same(one, other):
    return all((getattr(one, n) == getattr(other, n)).all() for n in ("one_key", "pair_key", "before_key", "one", "pair", "before", "total"))


def test_every_text_of_a_table_counts(spark):
    """More texts than any sample: what the table's model knows is what a model of all its texts knows, damaged ones taken off."""
    texts = [f"{w} {k}" for k in range(70) for w in ("café", "naïve – no", "Größe", "plain", "価格は高い。", "价格很好")] * 10 + [f"Gr{E.garble('ß', 'utf-8', 'cp1252')}e {k}" for k in range(9)] + [f"ab {E.garble('東京の店', *p)} {k}" for k in range(3) for p in E.PAIRS]
    data = [(i, t) for i, t in enumerate([*texts, None, ""])]
    got, want = E.fit(spark.createDataFrame(data, "doc_id bigint, text string")), E.Model(texts)
    assert got.total[0] > 4100 and same(got, want)


def test_tally_equals_counts_over_whole_garbled_texts():
    """Leaving out the middle of ASCII, and spelling out characters once, changes no count."""
    import random
    from collections import Counter

    r, alphabet = random.Random(7), ["é", "ß", "’", "→", "я", "日", "ソ", "亂", "カ", "한", "𠀀", "\ud800", "?", "?", "??", "???", "a", "B", "7", " ", "\n", "@", "~", "long words 12", "x" * 12]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    texts = [t for t in [*texts, *CLEAN[:14]] if "????" not in t]
    want = Counter()
    for t in texts:
        east = E._EAST.search(t) is not None
        made = {0: t}
        if not t.isascii():
            for k, (true, used, n) in enumerate(E.PAIRS, 1):
                if (true == "utf-8" or east == (true != "cp1252")) and (east or used not in ("gb18030", "cp932")) and (bad := E.garble(t, true, used, n)) != t:
                    made[k] = bad
            made[E.LOST] = t.encode("ascii", "replace").decode() if len(t) % 2 else t.encode("cp1252", "ignore").decode("utf-8", "replace")
        for k, x in made.items():
            sym, _, _, at = E.symbols([x])
            pairs = [(b << 21) | s for b, s in zip(E._before(sym, at).tolist(), sym.tolist())]
            want.update((k << 42) | p for p in pairs)
            want.update((E.TEXTS << 42) | p for p in (set(pairs) if not k else ()))
    want[E.TEXTS << 42] = len(texts)
    keys, n = E.tally(texts)
    assert dict(zip(keys.tolist(), n.tolist())) == dict(want)


@pytest.mark.parametrize("text", ["The export is in.\n\n————————\nNothing to add.", "In January\nThe Müller collection had 9 boxes.", "At the São Paulo meet-up 7 boxes were sold."])
def test_damage_that_stands_in_the_fitted_texts_does_not_vouch_for_itself(text):
    texts = [TEXTS[n].format(n=17 * k + 3) + f" {k}" for k in range(700) for n in ("en", "de", "fr", "pt", "zh")]
    bad = E.garble(text, "cp1252", "cp437" if "—" in text else "cp850" if "ü" in text else "mac_roman")
    damaged, _, restored, _ = E.Model([*texts, bad]).read([bad])[0]
    assert damaged and restored == text
