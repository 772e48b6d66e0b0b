import hashlib
import zlib

import numpy as np
import pytest

from veilwork.llm import media, webp
from veilwork.llm import webp_bits as wb

from .conftest import ROWS, sorted_rows

RNG = np.random.default_rng(7)


def image(kind, n):
    if kind == "noise":
        return RNG.integers(0, 1 << 24, n).astype(np.uint32) | np.uint32(webp.OPAQUE)
    if kind == "alpha":
        return RNG.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    if kind == "few":
        return (RNG.integers(97, 110, n) * 0x10101).astype(np.uint32) | np.uint32(webp.OPAQUE)
    if kind == "repeats":
        return np.tile(image("noise", 37), n // 37 + 1)[:n]
    return np.full(n, 0xFF202020, np.uint32)


def check(px, width, **how):
    w, h, got = webp.decode(webp.encode(px, width, **how))
    assert (w, h) == (width, len(px) // width) and np.array_equal(got, px)


@pytest.mark.parametrize("kind", ["noise", "alpha", "few", "repeats", "flat"])
@pytest.mark.parametrize("width,height", [(1, 1), (64, 1), (64, 40), (7, 9), (33, 20), (2, 70)])
def test_round_trips(kind, width, height):
    px = image(kind, width * height)
    for cache_bits in (0, 1, 6, 11):
        for groups in (0, 2, 4):
            for copies in (True, False):
                check(px, width, cache_bits=cache_bits, groups=groups, copies=copies, palette=False)
    check(px, width)
    for bits in (2, 4):
        n = webp.blocks_of(width, bits) * webp.blocks_of(height, bits)
        modes = (RNG.integers(0, 14, n) << 8).astype(np.uint32) | np.uint32(webp.OPAQUE)
        check(px, width, transforms=((webp.PREDICTOR, bits, modes),))
        check(px, width, transforms=((webp.CROSS, bits, image("noise", n)), (webp.GREEN,), (webp.PREDICTOR, bits, modes)))


def slow_prediction(mode, left, top, right, corner):
    """The predictors of the format, a channel value at a time."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        near = [l + t - c for l, t, c in zip(left, top, corner)]
        to_left, to_top = (sum(abs(p - x) for p, x in zip(near, side)) for side in (left, top))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(l + t - c) for l, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(avg(left, top), corner)]
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top),
        8: avg(corner, top), 9: avg(top, right), 10: avg(avg(left, corner), avg(top, right)),
    }[mode]


def test_predictors():
    for mode in range(14):
        sides = RNG.integers(0, 256, (4, 200, 4)).astype(np.int16)
        got = webp.predictions(np.full(200, mode), *sides)
        assert got.tolist() == [slow_prediction(mode, *(s[i].tolist() for s in sides)) for i in range(200)]


def test_stretches_equal_symbols(monkeypatch):
    px = np.concatenate([image("few", 64 * 90), image("noise", 64 * 10), image("repeats", 64 * 60)])
    raw = webp.encode(px, 64)
    fast = webp.decode(raw)[2]
    monkeypatch.setattr(webp, "STRETCH", 1 << 10)
    many = webp.decode(raw)[2]
    slow = lambda r, w, n, codes: webp._read_symbols(r, w, n, [codes], None, 0, 0)
    monkeypatch.setattr(webp, "_read_stretches", slow)
    assert np.array_equal(fast, px) and np.array_equal(many, px) and np.array_equal(webp.decode(raw)[2], px)


def test_codes_are_prefix_free_and_complete():
    for _ in range(50):
        counts = RNG.integers(0, 1 << RNG.integers(1, 30), RNG.integers(2, 300)) * RNG.integers(0, 2, 1)[0]
        counts[:2] += 1
        lengths = wb.code_lengths(counts)
        assert lengths.max() <= wb.MAX_BITS and sum(2.0 ** -int(x) for x in lengths if x) == 1
        table, bits = wb.table_of(lengths)
        for s, (c, n) in enumerate(zip(wb.codes_of(lengths).tolist(), lengths.tolist())):
            assert not n or table[c] == s << 4 | n


def test_distances_and_prefixes():
    assert wb.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and len(wb.NEAR) == 120
    assert wb.NEAR[-4:] == [(7, 7), (-7, 7), (8, 6), (8, 7)]
    for v in [*range(1, 5000), 1 << 19]:
        s, n, extra = wb.prefix_of(v)
        assert wb.value_of(s, lambda k: extra if k == n else 1 / 0) == v


def brute(rows):
    out = []
    for i, t in rows:
        b = (t or "").encode()
        p = b.ljust(max(192, -(-len(b) // 192) * 192))
        out.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    return sorted(out, key=repr)


def test_media_columns(odd, clashing, empty):
    expected = brute([(r[0], r[1]) for r in ROWS])
    for docs in (odd, clashing):
        got = media.media_columns(docs)
        rows = got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
        assert sorted_rows(rows) == expected
        assert got.where("length(pixels) <> payload_bytes").count() == 0
    same = media.media_columns(odd, with_pixels=False).where("doc_id in (10, 11)").drop("doc_id").distinct()
    assert same.count() == 1
    assert media.media_columns(empty).collect() == []


def test_high_values_are_several_files():
    payload = bytes(RNG.integers(97, 123, media.ROW * (webp.MAX_SIDE + 5), dtype=np.uint8))
    stored = media.to_webp(payload)
    assert len(list(webp.files(stored))) == 2 and media.from_webp(stored).tobytes() == payload


def test_values_written_with_all_tools_are_read_back(monkeypatch):
    used = set()
    for name in ("undo_predictor", "cross_colour", "green", "_read_symbols"):
        plain = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, plain=plain, name=name: (used.add(name), plain(*a))[1])
    for n in (1, 2, 17, 40):
        payload = media.padded(" ".join(f"word{k % 7} and{k}" for k in range(19 * n)).encode())
        stored = media.to_webp(payload, every=1)
        used.clear()
        assert media.from_webp(stored).tobytes() == payload
        assert used == {"undo_predictor", "cross_colour", "green", "_read_symbols"}
        assert stored != media.to_webp(payload, every=1 << 40)


def test_the_query_reads_every_path(spark):
    texts = [f"text number {i} " * 30 for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = [t for t in texts if zlib.crc32(media.padded(t.encode())) % media.EVERY == 0]
    assert full
    got = media.media_columns(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert sorted_rows(got) == brute(list(enumerate(texts)))


def test_files_of_another_writer():
    """Two published single-pixel files of the format's own library."""
    import base64

    for text in ("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="):
        width, height, px = webp.decode(base64.b64decode(text))
        assert (width, height, len(px)) == (1, 1, 1)


def smooth(height):
    """A picture in which each sample is near the ones before it."""
    ch = np.add.accumulate(RNG.integers(0, 3, (64 * height, 3)), axis=0).astype(np.uint8)
    return ch.tobytes()


def test_every_value_is_planned_with_all_tools(monkeypatch):
    never = 1 << 40
    words = [f"w{k:02d}" for k in RNG.permutation(90)]
    triples = " ".join(words[k] for k in RNG.integers(0, 90, 900)).encode()
    payloads = {"predictor": smooth(20), "cache": media.padded(b"".join(f"{k:03x}".encode() for k in (RNG.random(20000) ** 4 * 900).astype(int)))}
    letters = np.where(np.arange(64 * 64) // 16 % 2, 97, 200)[:, None] + RNG.integers(0, 20, (64 * 64, 3))
    payloads["groups"] = letters.astype(np.uint8).tobytes()
    grey = np.repeat(RNG.integers(0, 256, 64 * 30, dtype=np.uint8), 3).reshape(-1, 3)
    payloads["green"] = (grey + RNG.integers(0, 3, grey.shape, dtype=np.uint8)).tobytes()
    seen = {}
    encode = webp.encode
    monkeypatch.setattr(webp, "encode", lambda px, width, **how: (seen.setdefault("how", []).append(how), encode(px, width, **how))[1])
    for name, payload in payloads.items():
        seen.clear()
        stored = media.to_webp(payload, every=never)
        used = [h for h in seen["how"] if h]
        assert media.from_webp(stored).tobytes() == payload and len(used) == 1
        kinds = [t[0] for t in used[0].get("transforms", ())]
        assert {"predictor": webp.PREDICTOR in kinds, "green": webp.GREEN in kinds or webp.CROSS in kinds}.get(name, True)
        assert name not in ("cache", "groups") or used[0].get({"cache": "cache_bits", "groups": "groups"}[name])
        rgb = np.full((len(payload) // 3, 4), 255, np.uint8)
        rgb[:, :3] = np.frombuffer(payload, np.uint8).reshape(-1, 3)[:, ::-1]
        assert len(stored) < len(encode(webp.pixels(rgb), 64))
    assert media.from_webp(media.to_webp(media.padded(triples), every=never)).tobytes() == media.padded(triples)


@pytest.mark.parametrize("height", [1, 3, 17, webp.PLAN_ROWS + 20])
def test_planned_residuals_are_what_the_predictors_leave(height):
    for px in (image("noise", 64 * height), image("few", 64 * height)):
        block, rest = webp.plan_predictors(px, 64)
        assert np.array_equal(rest, webp.predicted(px, 64, height, webp.PLAN_BITS, block))
        assert np.array_equal(webp.decode(webp.encode_best(px, 64))[2], px)


def test_symbols_cross_stretches(monkeypatch):
    px = np.concatenate([image("noise", 64 * 50), image("repeats", 64 * 60)])
    raw = webp.encode(px, 64, cache_bits=6, groups=4, palette=False)
    monkeypatch.setattr(webp, "STRETCH", 1 << 7)
    assert np.array_equal(webp.decode(raw)[2], px)


def test_cached_images_need_no_step_per_symbol(monkeypatch):
    """F2 of round 2: caches and copies, also of one another, are followed back for all pixels at once."""
    px = np.concatenate([image("few", 64 * 40), image("repeats", 64 * 60), image("noise", 64 * 3), image("few", 64 * 9)])
    again = np.concatenate([px, px[64 * 30 : 64 * 80], px])
    raws = [(x, webp.encode(x, 64, palette=False, cache_bits=bits, copies=copies)) for x in (px, again) for bits in (1, 4, 10) for copies in (False, True)]
    slow = webp._read_symbols
    monkeypatch.setattr(webp, "_read_symbols", lambda r, w, n, *more: slow(r, w, n, *more) if n <= 64 else 1 / 0)
    for stretch in (webp.STRETCH, 1 << 10):
        monkeypatch.setattr(webp, "STRETCH", stretch)
        for x, raw in raws:
            assert np.array_equal(webp.decode(raw)[2], x)


def test_a_cache_read_before_it_holds_anything():
    px = np.array([webp.OPAQUE + 1, 0, 0], dtype=np.uint32)
    slot = int((px * np.uint32(webp.CACHE_MUL))[0] >> np.uint32(30))
    assert webp._from_cache(px, np.array([-1, slot ^ 1, slot]), [], 2) is None
    assert webp._from_cache(px, np.array([-1, slot, slot]), [], 2).tolist() == [px[0]] * 3


def test_images_planned_together_get_their_own_plans():
    images = [image(kind, 64 * h) for h in (1, 16, 17, 40, webp.PLAN_ROWS + 3) for kind in ("noise", "few", "repeats")]
    images += [webp.pixels(np.pad(np.frombuffer(smooth(h), np.uint8).reshape(-1, 3), ((0, 0), (0, 1)), constant_values=255)) for h in (5, 33)]
    together = webp.encode_each(images, 64)
    assert together == [webp.encode_best(px, 64) for px in images]
    assert all(np.array_equal(webp.decode(raw)[2], px) for raw, px in zip(together, images))
    assert all(len(raw) <= len(webp.encode(px, 64)) for raw, px in zip(together, images))
    assert webp.encode_each([], 64) == []


def varied(n):
    """Payloads of many lengths: sentences, copies, few letters, digits that a cache serves, bytes of every value."""
    words = [f"{a}{b}" for a in ("river", "stone", "light", "Über", "7") for b in ("", "s", " of", ", and", ".\n")]
    out = []
    for k in range(n):
        text = " ".join(words[j] for j in RNG.integers(0, len(words), RNG.integers(1, 40 + 20 * (k % 40))))
        kinds = (text, text + text, "ab" * len(text), "".join(f"{j:03x}" for j in (RNG.random(len(text)) ** 4 * 900).astype(int)))
        out.append(media.padded(bytes(RNG.integers(0, 256, len(text), dtype=np.uint8)) if k % 5 == 4 else kinds[k % 5].encode()))
    return out


def test_many_values_take_few_steps_each():
    """op7_media of round 2: no value pays for its own array operations, neither where it is written nor where it is read."""
    import cProfile
    import pstats

    payloads = [media.padded(f"{k} {' '.join(f'word{j * k % 101}' for j in range(90))}".encode()) for k in range(400)]
    payloads = [p for p in payloads if zlib.crc32(p) % media.EVERY]
    media.to_webps(payloads[:2])

    def calls(work):
        profile = cProfile.Profile()
        got = profile.runcall(work)
        return got, pstats.Stats(profile).total_calls / len(payloads)

    stored, writing = calls(lambda: media.to_webps(payloads))
    assert writing < 850
    images, reading = calls(lambda: list(media.from_webps(stored)))
    assert [x.tobytes() for x in images] == payloads and reading < 735


@pytest.mark.parametrize("few,steps", [(1, 3), (40, 256), (10**9, 256)])
def test_values_read_together_are_what_they_are_alone(monkeypatch, few, steps):
    payloads = varied(150) + [media.padded(b""), bytes(RNG.integers(97, 123, media.ROW * (webp.MAX_SIDE + 5), dtype=np.uint8))]
    stored = media.to_webps(payloads, every=9)
    assert stored == [media.to_webp(p, every=9) for p in payloads]
    monkeypatch.setattr(webp, "FEW_LANES", few)
    monkeypatch.setattr(webp, "LANE_STEPS", steps)
    monkeypatch.setattr(webp, "LANES", 100)
    assert [x.tobytes() for x in media.from_webps(stored)] == payloads
    assert list(media.from_webps([])) == []


def test_together_reads_caches_copies_and_alpha(monkeypatch):
    images = [image(kind, 64 * h) for h in (2, 5, 40) for kind in ("noise", "alpha", "few", "repeats", "flat")]
    raws = [(x, webp.encode(x, 64, palette=False, cache_bits=bits, copies=copies)) for x in images for bits in (0, 1, 6, 11) for copies in (False, True)]
    monkeypatch.setattr(webp, "FEW_LANES", 2)
    got = webp.decode_each([raw for _, raw in raws])
    assert all(np.array_equal(px, x) for (x, _), (_, _, px) in zip(raws, got, strict=True))


def test_a_cut_stream_among_others_is_an_error(monkeypatch):
    monkeypatch.setattr(webp, "FEW_LANES", 1)
    raws = [webp.encode(image("noise", 64 * 9), 64) for _ in range(5)]
    body = raws[1][20:-900]
    raws[1] = webp._file(body)
    with pytest.raises(ValueError, match="ends early"):
        list(webp.decode_each(raws))


def test_images_written_together_have_the_bytes_of_encode():
    images = [image(kind, 64 * h) for h in (1, 3, 30) for kind in ("noise", "few", "repeats", "flat")]
    images.append(np.concatenate([image("noise", 64 * 4), np.full(640, webp.OPAQUE + 5, np.uint32), image("few", 640)]))
    images.append(np.concatenate([images[-1], images[-1][:300], images[-1][-340:]]))
    px, of = np.concatenate(images), np.repeat(np.arange(len(images)), [len(x) for x in images])
    copies = webp.find_copies_each(px, of, len(images))
    assert copies == [webp.find_copies(x) for x in images] and copies[-1] and not copies[0]
    for i, found in enumerate(copies):
        for a, n, d in found:
            assert all(images[i][j] == images[i][j - d] for j in range(a, a + n)) and d <= a
    shared = webp.SharedCodes(px, of, copies, 64)
    for some in (list(range(len(images))), [1, 4, len(images) - 1], []):
        assert shared.files(some) == [webp.encode(images[i], 64, palette=False) for i in some]


def test_codes_of_each_row():
    rows = np.stack([wb.code_lengths(RNG.integers(0, 1 << b, 280) * RNG.integers(0, 2, 280)) for b in (1, 2, 9, 20)])
    assert np.array_equal(wb.codes_of_each(rows), np.stack([wb.codes_of(x) for x in rows]))
    assert not wb.codes_of_each(np.zeros((2, 5), np.uint8)).any()


def test_images_read_together_have_few_pixels(monkeypatch):
    """Files that are short but large: as many are taken together as their pixels allow."""
    images = [np.full(64 * h, webp.OPAQUE, np.uint32) for h in (10, 20, 30, 200, 5, 5)]
    taken, plain = [], webp._decode_together
    monkeypatch.setattr(webp, "LANE_PIXELS", 64 * 60)
    monkeypatch.setattr(webp, "_decode_together", lambda raws: (taken.append(len(raws)), plain(raws))[1])
    got = [px for _, _, px in webp.decode_each([webp.encode(x, 64) for x in images])]
    assert taken == [3, 1, 2] and all(np.array_equal(a, b) for a, b in zip(got, images, strict=True))
