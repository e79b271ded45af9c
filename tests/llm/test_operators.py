"""Each training-data operator against a brute-force version on small fixtures, awkward rows included."""

import functools
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, common, decontaminate, main_text, near_dup, quality, substring_dedup, suffix, token_counts, token_files, weak_labels

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", " ", "\n\n \t", "a", "A  b\nc", "a b c d e f", "é İ Σ ΑΣΣ 日本語 テキスト 😀", "x" * 3000, "xy " * 700, "it's 'S we'LL 12345 ½², <|endoftext|> <|startoftext|>b",
    "foo  <|endoftext|> bar \x1c \x85 z", "\x00 \x01a", "the the of the", "</w> Ġ <s> </s> ▁▁ ",
]


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in common.read(spark, SF, "documents").select("doc_id", "text").collect()]
    docs += [(10_000 + i, t) for i, t in enumerate(ODD)]
    return docs + [(10_003, ODD[3]), (10_006, ODD[6]), (10_006, ODD[6]), (None, "some text without a name"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("row", "n", "kept", "key", "ids", "spans", "rid", "node", "tie")}).withColumns({"lang": F.lit(None).cast("string"), "source": F.when(F.col("doc_id") % 2 == 0, "s")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def as_set(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_op1_token_files(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = common.shared_dir(spark, "test")
    token_files.write_token_files(docs, path, 2, folder, shard_ids=20_000)
    found = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert ids == sorted(ids) and [r["doc_id"] for r in found[:2]] == [None, None]
    start, got, want = 0, defaultdict(list), defaultdict(list)
    for r in found:
        assert r["start"] == start and len(r["ids"]) == 4 * r["n_tokens"]
        start += r["n_tokens"]
        got[r["doc_id"]].append(bytes(r["ids"]))
    for doc_id, text in rows:
        want[doc_id].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_files.token_files(empty, path, 2).count() == 0


def test_code_lengths_are_optimal_within_the_limit():
    import heapq

    rng = np.random.default_rng(2)
    counts = rng.integers(1, 1000, 300)
    heap, cost = list(map(int, counts)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (token_files.code_lengths(counts, 40) * counts).sum() == cost
    skewed = 2 ** np.arange(40, dtype=np.int64)
    lengths = token_files.code_lengths(skewed, 8)
    assert lengths.max() == 8 and (0.5**lengths).sum() == 1


def test_op2_main_text(spark):
    page = main_text.main_text
    assert page(None) == page("") == page("<nav><a>x</a></nav>") == ""
    assert page("<article><header><h1>T</h1></header>a &amp;\n b<aside>x</aside><p>c&nbsp; d<br><p></article><footer>f</footer>") == "T\na & b\nc d"
    assert page("<nav><li>a<article><p>kept</article>") == "kept"
    body = "<p>" + "word " * 40 + "<p>Short.<p>" + "more " * 30
    assert page(f'<div class="sidebar"><p>side</div><div>{body}</div><form>f</form><div id="comments"><p>{"c " * 90}</div>').split("\n")[1] == "Short."
    assert page('<script>if(a<b){"</p>"}</script><style>p{}</style><p>plain') == "plain"
    assert "c c" not in page(f'<p>{"z " * 60}</p><section class="user-comments"><p>{"c " * 90}</section>')
    pages = common.read(spark, SF, "pages").withColumn("row", F.lit(1))
    found = {r["page_id"]: r for r in main_text.extract(pages).collect()}
    import html

    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:h1|p|br)>", inner)]
        assert found[r["page_id"]]["text"] == "\n".join(b for b in blocks if b) and found[r["page_id"]]["n_chars"] == len(found[r["page_id"]]["text"])


@pytest.mark.parametrize("block_bytes", [8_000_000, 5_000])
def test_op3_decontamination(spark, docs, rows, empty, block_bytes):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall((t or "").translate(LOWER))
    items = [(r["item_id"], r["text"]) for r in common.read(spark, SF, "benchmark").collect()]
    items += [(900, "the"), (901, "Of the"), (902, None), (903, "!!"), (None, rows[3][1]), (904, rows[3][1]), (905, " ".join(t or "" for _, t in rows[:5]))]
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add("" if item is None else str(item))
    want = []
    for doc_id, text in rows:
        w, seen = words(text), set()
        hit = [False] * len(w)
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    seen |= own
                    hit[k : k + size] = [True] * size
        n = sum(hit)
        want.append((doc_id, len(w), n, len(seen), sha(",".join(sorted(seen))), n > 0 and 20 * n >= len(w)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert as_set(decontaminate.contamination(docs, benchmark, block_bytes=block_bytes), *columns) == sorted(want, key=str)
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert not decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count()


def test_suffix_array_by_grouping():
    random.seed(4)
    for _ in range(1500):
        symbols = [random.randrange(random.choice([1, 2, 3, 9])) for _ in range(random.randrange(40))]
        assert suffix.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@pytest.mark.parametrize("max_group", [512, 4])
def test_op4_substring_dedup(spark, empty, max_group):
    random.seed(5)
    some = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passage = some(700)
    rows = [(None, passage), (1, None), (2, ""), (3, "a" * 1200), (4, passage), (4, passage), (5, "xy" * 900), (6, some(399))]
    rows += [(10 + i, some(random.randrange(300)) + passage[random.randrange(150) : random.randrange(420, 700)] + some(random.randrange(300))) for i in range(40)]
    counts = Counter(b[i : i + 400] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - 399))
    want = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 399):
            if counts[data[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want.append((doc_id, len(data), sum(gone), runs, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("rid", F.lit(1))
    found = substring_dedup.without_repeats(docs, max_group=max_group, bundle=20).withColumn("sha", F.sha2("kept", 256))
    assert as_set(found, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(want, key=str)
    assert substring_dedup.without_repeats(empty).count() == 0
    kept = substring_dedup.keep_rest(docs.withColumn("n_chars", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "rid", "n_chars"] and kept.where("n_chars <> char_length(text)").count() == 0


def test_op5_token_counts(spark, docs, rows, empty):
    path = common.tokenizer_path("piece_bpe_32k.model")
    model = token_counts.piece_model(path)
    long = " ".join(t or "" for _, t in rows[:40])
    more = [(20_000, long), (20_001, long.replace(" ", "")), (20_002, "a" * 5000), (20_003, "日本語テキスト" * 600), (20_004, "x " * 4000)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    want = [(i, len((t or "").encode()), n, n > 4096) for i, t in rows + more for n in [len(model.encode(t or ""))]]
    found = token_counts.token_counts(both, path, long_chars=2000, chunk=700, overlap=16)
    assert as_set(found, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=str)
    assert token_counts.token_counts(empty, path).count() == 0


def test_op6_quality_rules(docs, rows, empty):
    word = re.compile("[^\x20\x09-\x0d]+")
    want = []
    for doc_id, text in rows:
        text = text or ""
        w = word.findall(text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if word.search(x)]
        base = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base))
    found = quality.quality(docs)
    assert as_set(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=str)
    assert found.where("base_failed and kept").count() == 0
    assert quality.quality(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == found.where("kept").count()


def test_op6_finds_planted_outliers_and_keeps_the_rest(spark):
    random.seed(6)
    words = ["".join(random.choice("etaoinshr") for _ in range(random.randrange(2, 9))) for _ in range(2000)]
    clean = [(i, " ".join(random.choices(words, k=random.randrange(30, 200))) + ".", "en", "s0" if i % 3 else f"s{i % 7}") for i in range(1200)]
    bad = [(5000 + i, " ".join(w + random.choice(["***", "$$$"]) for w in random.choices(words, k=60)), "en", "s0") for i in range(40)]
    found = quality.quality(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string"))
    assert found.where("doc_id < 5000 and not kept").count() == 0
    assert found.where("doc_id >= 5000 and kept").count() == 0


def test_op6_judges_small_sources_and_rare_languages(spark):
    random.seed(16)
    words = ["".join(random.choice("etaoinshr") for _ in range(random.randrange(2, 9))) for _ in range(2000)]
    kinds = [("en", "large")] * 600 + [("de", "large")] * 300 + [("en", "tail")] * 9 + [("rare", "s")] * 20 + [("", "s")] * 9
    clean = [(i, " ".join(random.choices(words, k=random.randrange(30, 200))) + ".", *kind) for i, kind in enumerate(kinds)]
    bad = [(5000 + i, " ".join(w + random.choice(["***", "$$$"]) for w in random.choices(words, k=60)), *kind) for i, kind in enumerate([("en", "tail"), ("rare", "s"), ("", "s"), ("de", "new")])]
    found = quality.quality(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string"))
    assert found.count() == len(clean) + len(bad) and found.where("not base_failed and distance is null").count() == 0
    assert found.where("doc_id < 5000 and not kept").count() == 0
    assert found.where("doc_id >= 5000 and kept").count() == 0


def least_cost(roles):
    @functools.cache
    def go(i, state):
        if i == len(roles):
            return chat.ENDS[state][0]
        options = [chat.relabel_cost(roles[i], b) + go(i + 1, b) for b in chat.NEXT[state]]
        options += [chat.INSERT + chat.relabel_cost(roles[i], b) + go(i + 1, b) for between in chat.NEXT[state] for b in chat.NEXT[between]]
        if state != chat.START:
            options.append(chat.MERGE + chat.relabel_cost(roles[i], state) + go(i + 1, state))
        return min(options)

    return go(0, chat.START)


def test_op7_chat_format(spark):
    random.seed(7)
    rows, roles_of = [], {}
    for conv in range(60):
        roles_of[conv] = [random.choice(["user", "assistant", "system", "tool", None, " User "]) for _ in range(300 if conv == 7 else random.randrange(1, 9))]
        rows += [(conv, k, r, f"t{k}") for k, r in enumerate(roles_of[conv])]
    rows += [(None, 0, "user", None), (None, None, None, ""), (500, 1, "user", "x"), (500, 1, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).withColumn("pid", F.lit(1))
    found = chat.format_chats(table, 6).orderBy("conv_id", "position").collect()
    assert len(found) == len(rows)
    for conv, roles in roles_of.items():
        own = [r for r in found if r["conv_id"] == conv]
        assert [r["turn"] for r in own] == [r["position"] for r in own] == list(range(len(roles)))
        known = [r if r in chat.ROLES else "" for r in ((x or "").strip().lower() for x in roles)]
        cost = sum(chat.relabel_cost(k, 1 + chat.ROLES.index(r["role"])) + chat.MERGE * (r["action"] == "merge") + chat.INSERT * len([x for x in r["inserted"].split(",") if x]) for k, r in zip(known, own, strict=True))
        assert cost == least_cost(tuple(known))
        text = "".join(r["rendered"] for r in own)
        order = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert re.fullmatch(r"s?(ua)+", "".join(x[0] for x in order)) and text.count("<|end|>") == len(order)
    assert chat.format_chats(table.limit(0)).count() == 0


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def component_rows(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        common_with = Counter(j for g in s for j in having[g])
        for g in s:
            having[g].append(i)
        for j, k in common_with.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)]


def test_op8_near_dedup(docs, rows, empty):
    found = near_dup.near_duplicates(docs)
    assert as_set(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(component_rows(rows), key=str)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(named) == sorted({d for d, _, _, k in component_rows(rows) if k and d is not None})


def test_op8_large_groups_in_blocks(spark):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [random.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 5, 6, 8])):
            words[random.randrange(150)] = random.choice(vocabulary)
        rows.append((i, " ".join(words)))
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), small=6, block=40, steps=(1, 2))
    assert as_set(found, "doc_id", "n_shingles", "component_id", "kept") == sorted(component_rows(rows), key=str)


def test_op8_sketches_fill_and_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    values = np.concatenate([both, a, both, b, both[:3]])
    sketch = near_dup.sketches(values, np.array([0, 800, 1600, 1603, 1603]), 256)
    assert (sketch[:3] != 2**64 - 1).all() and not sketch[3].any()
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.15


def test_op9_quality_classifier(spark, empty):
    docs, labels = common.read(spark, "/root/testdata/sf0.01", "documents"), common.read(spark, "/root/testdata/sf0.01", "labels")
    found = weak_labels.classify(docs, labels)
    held = found.join(labels.select("doc_id", "quality", F.col("toxic").alias("is_toxic")), "doc_id").collect()
    right = lambda got, told: sum((r[got] == bool(told(r))) for r in held) / len(held)
    assert right("low_quality", lambda r: r["quality"] == 0) > 0.95
    assert right("toxic", lambda r: r["is_toxic"]) > 0.9
    assert weak_labels.classify(empty).count() == 0


def test_op9_recall_and_false_alarms(spark):
    docs, labels = common.read(spark, "/root/testdata/sf0.1", "documents"), common.read(spark, "/root/testdata/sf0.1", "labels")
    held = weak_labels.classify(docs, labels).join(labels.select("doc_id", "quality", F.col("toxic").alias("is_toxic")), "doc_id").collect()

    def rates(got, told):
        bad, good = [r[got] for r in held if told(r)], [r[got] for r in held if not told(r)]
        return sum(bad) / len(bad), sum(good) / len(good)

    recall, alarms = rates("low_quality", lambda r: r["quality"] == 0)
    assert recall > 0.88 and alarms < 0.01
    recall, alarms = rates("toxic", lambda r: r["is_toxic"])
    assert recall > 0.9 and alarms < 0.015


def test_op9_learns_from_1500_documents_a_class(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(weak_labels, "train", lambda c, v, o, labels, weights: (seen.append((labels >= 0.5).sum()), seen.append((labels < 0.5).sum()), np.zeros(weak_labels.DIMENSIONS), 0.0)[2:])
    bad = [(i, f"this idiot number {i} is stupid and this is the trash of it") for i in range(1600)]
    good = [(i, f"this is number {i} of the things that are good for it") for i in range(1600, 3200)]
    weak_labels.classify(spark.createDataFrame(bad + good, "doc_id long, text string"))
    assert seen[2:] == [1500, 1500]  # of the second task, toxic


def test_op9_repeated_rows_are_one_of_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(weak_labels, "train", lambda c, v, o, labels, weights: (seen.append(sorted(labels >= 0.5)), np.zeros(weak_labels.DIMENSIONS), 0.0)[1:])
    bad = [(7, "this idiot is stupid and this is the trash of it")] * 300 + [(None, "that idiot is stupid and this is the trash of it")] * 300 + [(i, f"this idiot number {i} is stupid and this is the trash of it") for i in range(10, 20)]
    good = [(i, f"this is number {i} of the things that are good for it") for i in range(100, 130)]
    found = weak_labels.classify(spark.createDataFrame(bad + good, "doc_id long, text string").repartition(5), sample=20)
    assert seen[1] == [False] * 20 + [True] * 12  # of the second task, toxic
    assert found.count() == 640


def test_op9_accuracies_of_simulated_labellers():
    rng = np.random.default_rng(9)
    bad = rng.random(20_000) < 0.1
    patterns = np.zeros(len(bad), np.int64)
    for k, (hit, alarm) in enumerate([(0.9, 0.002), (0.7, 0.003), (0.5, 0.001), (0.8, 0.002)]):
        patterns += 3**k * (rng.random(len(bad)) < np.where(bad, hit, alarm))
    seen, counts = np.unique(patterns, return_counts=True)
    model = weak_labels.WeakLabels(seen, counts, 4)
    assert abs(model.prior - 0.1) < 0.02 and np.abs(model.table[:, 1, weak_labels.BAD] - [0.9, 0.7, 0.5, 0.8]).max() < 0.06
    assert ((model.posterior(patterns) > 0.5) == bad).mean() > 0.98


def test_op10_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = common.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    for block in (20_000_000, 3000):
        found = bpe.digests(bpe.encode(docs, path, block_chars=block))
        assert as_set(found, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.encode(empty, path).count() == 0


def test_pipeline_keeps_columns_and_agrees_with_its_operators(spark):
    import corpus_pipeline

    kept = common.read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = common.stored(stage(spark, before, SF), name)
        assert kept.columns == before.columns
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in kept.collect()}


def test_op1_pieces_are_those_of_their_pattern():
    rng = random.Random(1)
    letters = "ab é×.,!  \n\t\u2000\u3000\xa0\x85#xß漢😀9_ɏɐ "
    for _ in range(1500):
        texts = ["".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(rng.randrange(7))]
        pieces, begins = token_files.pieces_of([x.encode() for x in texts])
        found = pieces.to_pylist()
        assert [found[a:b] for a, b in zip(begins, begins[1:], strict=False)] == [token_files.PIECE.findall(x) for x in texts]
