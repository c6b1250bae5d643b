"""Media columns: cropped and edited copies of images by local descriptors.

1. Decode (binary PGM, or PNG of any kind; JPEG and other formats can't be decoded) to grey values.  Images of more than `WORK`
   pixels, or with a longer side than `SIDE_MOST`, are scaled down to that.
2. At each scale of a pyramid, corners are local maxima of the structure tensor's smaller-eigenvalue measure; the strongest
   `PER_CELL` of each `CELL` x `CELL` cell are kept, so their number goes with the image's area.  A corner's orientation is that of
   its patch's intensity centroid.
3. A descriptor is `BITS` comparisons of smoothed grey values at point pairs that are rotated into the orientation.
4. Hamming tables: a descriptor is cut into `TABLES` bands, and equal bands meet in one bucket.  All buckets are sorted by all bits of
   their descriptors over the whole cluster, and each descriptor meets the nearest of the `NEAR` before and of the `NEAR` behind it in
   its bucket, if at most `MET_BITS` bits differ.  A bucket that very many images share is spread over tasks and costs as much for each row as any other.
5. Geometric consensus: pairs of images with `PROBE` met corners in one cell of a coarse grid of transforms are compared by all their
   descriptors.  Descriptors that are each
   other's nearest, within `MOST_BITS`, match, and a match tells a similarity transform (scale, rotation, shift).  The images are copies
   if `CONSENSUS` matches follow the transform of one of them, and in images of many corners a share `LEAST_SHARE` of the fewer
   ones.  Classes are connected components; pairs within a class needn't be compared, so each image's likeliest partners (most
   matches of one transform, in a coarse grid) come first, and then all pairs that are still in two classes.
6. The search of step 4 is linear but leaves out what nearer descriptors hide.  So every two images that are still in two classes
   meet in tiles of two blocks of images: all their descriptors with an equal band and at most `MET_BITS` different bits count, however
   full the bucket, and each pair with `PROBE` of them in one cell is compared.  Its cost grows with the square of the images.

Images with equal bytes (64 hashed bits) are one image from the start.  Pairs whose corners never share a band aren't found;
the tests measure recall against comparing all pairs, with noise, rescaling, rotation, brightness and crops (see the README).

Null, empty and undecodable images have no descriptors and are a class of their own; so is an image without corners.  Equal
images are one class.  A null id orders after the others.  An empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected

SCALES = (1.0, 0.84, 0.71, 0.59, 0.5)
BITS, TABLES, MOST_BITS, CONSENSUS, LEAST_SHARE = 128, 4, 24, 6, 0.08
#: Corners kept of each cell at each scale.
CELL, PER_CELL = 24, 2
#: Descriptors behind one in its sorted bucket that the first search holds it against, bits in which it may differ from the nearest of them that
#: it meets; met corners of one transform from which on a pair of images is compared.
NEAR, MET_BITS, PROBE = 96, 20, 2
#: Corners of a block of images, blocks at least, and meetings and comparisons of corners in memory at once, when all blocks meet.
BLOCK, LEAST_BLOCKS, AT_ONCE, COMPARED = 400_000, 8, 1 << 16, 1 << 18
WORK, SIDE_MOST, MOST_PIXELS = 1 << 18, 8192, 1 << 28
RADIUS = 7
#: Grey levels by which two points have to differ, so that noise in flat parts sets no bits.
MARGIN = 1
_NO_ID = 2**63 - 1


# ---------------------------------------------------------------------------------------------------------------------
# decoding


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values as float32, or None if this isn't an image that can be read."""
    try:
        if not data:
            return None
        if data[:2] == b"P5":
            return _pgm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, ArithmeticError, LookupError, TypeError, zlib.error, MemoryError):
        pass
    return None


def _pgm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if not 0 < most < 65536 or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("bad header")
    kind = np.dtype(">u2") if most > 255 else np.dtype("u1")
    grey = np.frombuffer(data, kind, width * height, at + 1).astype(np.float32)
    return grey.reshape(height, width) * (255 / most)


def _png(data: bytes) -> np.ndarray:
    at, packed, head, colours = 8, [], None, None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"PLTE":
            colours = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.float32)
        at += 12 + n
    if head is None:
        raise ValueError("no header")
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, lace = head[8], head[9], head[12]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or depth not in (1, 2, 4, 8, 16) or (colour == 3 and (colours is None or depth > 8)) or lace > 1:
        raise ValueError("unsupported PNG")
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError("bad header")
    passes = [(x0, y0, dx, dy, len(range(x0, width, dx)), len(range(y0, height, dy))) for x0, y0, dx, dy in (_ADAM7 if lace else [(0, 0, 1, 1)])]
    sizes = [h * ((w * channels * depth + 7) // 8 + 1) if w and h else 0 for *_, w, h in passes]
    # no more is inflated than the header says
    raw, at = np.frombuffer(zlib.decompressobj().decompress(b"".join(packed), sum(sizes)), np.uint8), 0
    pixels = np.zeros((height, width, channels), np.float32)
    for (x0, y0, dx, dy, w, h), size in zip(passes, sizes):
        if size:
            pixels[y0::dy, x0::dx] = _png_pass(raw[at : at + size].reshape(h, -1), w, channels, depth)
            at += size
    if colour == 3:
        pixels = colours[pixels[..., 0].astype(int)]
    elif depth != 8:
        pixels *= 255 / ((1 << depth) - 1)
    return pixels[..., 0] if pixels.shape[-1] < 3 else pixels[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32)


#: First column and row, and steps, of the passes of an interlaced PNG.
_ADAM7 = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _png_pass(raw: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """The samples (h, width, channels) of filtered rows of bytes."""
    height, step = len(raw), max(1, channels * depth // 8)
    n, kinds = (raw.shape[1] - 1) // step, raw[:, 0]
    lines = raw[:, 1:].reshape(height, n, step).astype(np.int32)
    rows = np.zeros((height + 1, n + 1, step), np.int32)
    if (kinds < 3).all():
        for y, kind in enumerate(kinds):
            rows[y + 1, 1:] = lines[y] if kind == 0 else np.cumsum(lines[y], axis=0) & 255 if kind == 1 else (lines[y] + rows[y, 1:]) & 255
    else:
        # a sample needs those to the left and above: all samples of an antidiagonal at once
        for t in range(n + height - 1):
            y = np.arange(max(0, t - n + 1), min(height - 1, t) + 1)
            x, kind = t - y, kinds[y][:, None]
            a, b, c = rows[y + 1, x], rows[y, x + 1], rows[y, x]
            p = a + b - c
            pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            nearest = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, nearest], 0)
            rows[y + 1, x + 1] = (lines[y, x] + guess) & 255
    made = np.ascontiguousarray(rows[1:, 1:].astype(np.uint8).reshape(height, -1))
    if depth == 16:
        made = made.view(">u2")
    elif depth < 8:
        bits = np.unpackbits(made, axis=1).reshape(height, -1, depth)
        made = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2)[:, : width * channels]
    return made.reshape(height, width, channels)


def pgm(grey: np.ndarray) -> bytes:
    """A binary PGM of grey values."""
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


# ---------------------------------------------------------------------------------------------------------------------
# descriptors


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1) x (2r+1) cells of the last two axes, edges repeated."""
    for axis in (-2, -1):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad, mode="edge"), axis=axis, dtype=np.float64)
        n = x.shape[axis]
        k = 2 * r + 1
        x = (np.take(c, range(k, k + n), axis=axis) - np.take(c, range(n), axis=axis)).astype(np.float32) / k
    return x


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    h, w = max(1, int(x.shape[-2] * scale)), max(1, int(x.shape[-1] * scale))
    ys, xs = np.minimum(np.arange(h) / scale, x.shape[-2] - 1), np.minimum(np.arange(w) / scale, x.shape[-1] - 1)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, x.shape[-2] - 1), np.minimum(x0 + 1, x.shape[-1] - 1)
    fy, fx = (ys - y0)[:, None].astype(np.float32), (xs - x0).astype(np.float32)
    top = x[..., y0, :][..., x0] * (1 - fx) + x[..., y0, :][..., x1] * fx
    low = x[..., y1, :][..., x0] * (1 - fx) + x[..., y1, :][..., x1] * fx
    return top * (1 - fy) + low * fy


@functools.lru_cache(maxsize=1)
def _tests() -> tuple[np.ndarray, np.ndarray]:
    """(steps of 11.25 degrees, BITS, 2 points, y and x) offsets of the binary tests, and the orientation disc's offsets."""
    rng = np.random.default_rng(7)
    points = np.clip(rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS * 0.68, RADIUS * 0.68)
    turned = []
    for k in range(32):
        c, s = np.cos(k * np.pi / 16), np.sin(k * np.pi / 16)
        turned.append(np.stack([points[..., 0] * c + points[..., 1] * s, points[..., 1] * c - points[..., 0] * s], -1))
    disc = np.array([(y, x) for y in range(-RADIUS, RADIUS + 1) for x in range(-RADIUS, RADIUS + 1) if y * y + x * x <= RADIUS * RADIUS])
    return np.rint(np.array(turned)).astype(int), disc


def _worked(grey: np.ndarray) -> np.ndarray:
    """The image at the size at which it is described, by means over areas."""
    h, w = grey.shape
    scale = min(1.0, (WORK / (h * w)) ** 0.5, SIDE_MOST / max(h, w))
    if scale == 1:
        return grey
    for axis in (0, 1):
        n = grey.shape[axis]
        m = max(1, int(n * scale))
        edges = np.linspace(0, n, m + 1)
        c = np.concatenate([np.zeros_like(np.take(grey, [0], axis), np.float64), np.cumsum(grey, axis=axis, dtype=np.float64)], axis)
        low = np.minimum(edges.astype(int), n - 1)
        part = np.expand_dims(edges - low, 1 - axis)
        at = np.take(c, low, axis) + part * (np.take(c, low + 1, axis) - np.take(c, low, axis))
        grey = (np.diff(at, axis=axis) / (n / m)).astype(np.float32)
    return grey


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(image index, packed place, packed bits) of the corners of equally large images (n, h, w)."""
    tests, disc = _tests()
    found = []
    for scale in SCALES:
        x = _resized(images, scale)
        n, h, w = x.shape
        if min(h, w) < 2 * RADIUS + 3:
            continue
        smooth = _box(x, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        score = (a * b - c * c) / (a + b + 1e-3)
        near = np.pad(score, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
        peak = score > 0.5
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    other = near[:, dy : dy + h, dx : dx + w]
                    peak &= (score > other) if (dy, dx) < (1, 1) else (score >= other)
        m = RADIUS + 1
        peak[:, :m] = peak[:, -m:] = peak[:, :, :m] = peak[:, :, -m:] = False
        i, y, xx = np.nonzero(peak)
        if not len(i):
            continue
        cell = (i * (h // CELL + 1) + y // CELL) * (w // CELL + 1) + xx // CELL
        order = np.lexsort((-score[i, y, xx], cell))
        rank = np.arange(len(i)) - np.searchsorted(cell[order], cell[order])
        i, y, xx = (v[order[rank < PER_CELL]] for v in (i, y, xx))
        patch = smooth[i[:, None], y[:, None] + disc[:, 0], xx[:, None] + disc[:, 1]]
        angle = np.arctan2((patch * disc[:, 0]).sum(1), (patch * disc[:, 1]).sum(1))
        step = np.rint(angle / (np.pi / 16)).astype(int) % 32
        p = tests[step]
        v = smooth[i[:, None, None], y[:, None, None] + p[..., 0], xx[:, None, None] + p[..., 1]]
        bits = np.packbits(v[..., 0] + MARGIN < v[..., 1], axis=1)
        x4, y4 = np.rint(4 * xx / scale).astype(np.int64), np.rint(4 * y / scale).astype(np.int64)
        size = int(np.ceil(np.log2(max(images.shape[1:]))))
        place = x4 << 32 | y4 << 16 | size << 12 | SCALES.index(scale) << 8 | step
        found.append((i, place, bits))
    if not found:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros((0, BITS // 8), np.uint8)
    i, place, bits = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(i, kind="stable")
    return i[order], place[order], bits[order]


#: A corner: `place` holds x and y in quarter pixels (16 bits each), the logarithm of the image's longer side and the scale (4 bits
#: each) and the orientation step (8 bits); b0 and b1 its bits.
_OUT = "f1 long, f2 long, n_corners int, corners array<struct<place:long,b0:long,b1:long>>"


def descriptors(df: DataFrame, keep: dict[str, Column], image: str = "image") -> DataFrame:
    """`keep`, f1 and f2 (128 hashed bits of the image's bytes), n_corners and the image's described corners."""
    src = df.select(*[c.alias(k) for k, c in keep.items()], F.col(image).cast("binary").alias("_image"))
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string(_OUT).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        import xxhash

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in common.slices(column):
                blobs = column.slice(a, b - a).to_pylist()
                shapes: dict[tuple, list] = {}
                for i, data in enumerate(blobs):
                    g = decode(data)
                    if g is not None and g.size:
                        g = _worked(g)
                        shapes.setdefault(g.shape, []).append((i, g))
                corners: list[list] = [[] for _ in blobs]
                for members in shapes.values():
                    few = max(1, (1 << 19) // members[0][1].size)
                    for k in range(0, len(members), few):
                        part = members[k : k + few]
                        at, place, bits = describe(np.stack([g for _, g in part]))
                        words = np.ascontiguousarray(bits).view(np.int64) if len(bits) else np.zeros((0, 2), np.int64)
                        for j, p, w in zip(at.tolist(), place.tolist(), words.tolist()):
                            corners[part[j][0]].append({"place": p, "b0": w[0], "b1": w[1]})
                h = [xxhash.xxh3_128_intdigest(x or b"") for x in blobs]
                made = [
                    common.signed(np.array([x >> 64 for x in h], np.uint64)),
                    common.signed(np.array([x & (1 << 64) - 1 for x in h], np.uint64)),
                    np.array([len(c) for c in corners], np.int32),
                    corners,
                ]
                cols = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                cols += [pa.array(x, arrow.field(len(cols) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------------------------------------------------
# matching


def _geometry(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y in pixels, log2 of the scale, and the orientation in radians of packed places."""
    sizes = np.log2(np.array(SCALES))
    return (place >> 32 & 0xFFFF) / 4, (place >> 16 & 0xFFFF) / 4, sizes[place >> 8 & 0xF], (place & 0xFF) * (np.pi / 16)


def _transforms(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """(zoom, turn, x shift, y shift) that take the places a to the places b; zoom as a logarithm."""
    (xa, ya, sa, ta), (xb, yb, sb, tb) = _geometry(a), _geometry(b)
    zoom, turn = sa - sb, np.mod(tb - ta, 2 * np.pi)
    k, c, s = np.exp2(zoom), np.cos(turn), np.sin(turn)
    return zoom, turn, xb - k * (c * xa - s * ya), yb - k * (s * xa + c * ya)


@functools.lru_cache(maxsize=1)
def _turned() -> tuple[np.ndarray, ...]:
    """By both scales and the turn between two orientations: zoom times cosine and sine, and the cells of zoom and turn in two grids."""
    sizes = np.zeros(16)
    sizes[: len(SCALES)] = np.log2(np.array(SCALES))
    zoom = np.repeat(sizes[:, None] - sizes[None], 32)
    turn = np.tile(np.arange(32) * (np.pi / 16), 256)
    turns = int(np.ceil(2 * np.pi / 0.7))
    cells = [(np.floor(zoom / 0.9 + 0.5 + h) + 1) * 16 + np.mod(np.floor(turn / 0.7 + 0.5 + h), turns) for h in (0.0, 0.5)]
    return np.exp2(zoom) * np.cos(turn), np.exp2(zoom) * np.sin(turn), *[c.astype(np.int64) << 22 for c in cells]


def _cells(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each match's transform in two coarse grids, half a cell apart, as 29 bits; cells grow with the images."""
    kc, ks, *coarse = _turned()
    t = (a >> 8 & 0xF) << 9 | (b >> 8 & 0xF) << 5 | (b - a & 31)
    kc, ks = kc[t], ks[t]
    side = np.exp2(np.arange(16.0))[a >> 12 & 0xF]
    # where a point in the midst of the first image goes: errors of rotation and scale tell less there than at its edge
    x, y = (a >> 32 & 0xFFFF) / 4 - 0.375 * side, (a >> 16 & 0xFFFF) / 4 - 0.375 * side
    side = np.maximum(24, 0.1875 * side)
    tx, ty = ((b >> 32 & 0xFFFF) / 4 - kc * x + ks * y) / side, ((b >> 16 & 0xFFFF) / 4 - ks * x - kc * y) / side
    out = []
    for h, c in zip((0.0, 0.5), coarse):
        parts = [np.floor(z + h).astype(np.int64) & 0x7FF for z in (tx, ty)]
        out.append(int(2 * h) << 28 | c[t] | parts[0] << 11 | parts[1])
    return out[0], out[1]


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two images are copies; a and b: (places, bits (n, 2) as uint64)."""
    n = len(a[0]), len(b[0])
    need = max(CONSENSUS, int(np.ceil(LEAST_SHARE * min(n))))
    if min(n) < need:
        return False
    d = sum(np.bitwise_count(a[1][:, None, i] ^ b[1][None, :, i]).astype(np.int16) for i in range(2))
    i, j = np.arange(n[0]), d.argmin(1)
    ok = (d[i, j] <= MOST_BITS) & (d.argmin(0)[j] == i)
    i, j = i[ok], j[ok]
    if len(i) < need:
        return False
    pa_, pb = a[0][i], b[0][j]
    (xa, ya, _, _), (xb, yb, _, _) = _geometry(pa_), _geometry(pb)
    zoom, turn, _, _ = _transforms(pa_, pb)
    for m in range(len(i)):  # the match that the others have to follow
        k, c, s = np.exp2(zoom[m]), np.cos(turn[m]), np.sin(turn[m])
        dx, dy = xa - xa[m], ya - ya[m]
        ex, ey = xb - xb[m] - k * (c * dx - s * dy), yb - yb[m] - k * (s * dx + c * dy)
        off = np.mod(turn - turn[m] + np.pi, 2 * np.pi) - np.pi
        ok = (np.hypot(ex, ey) <= 3 + 0.1 * k * np.hypot(dx, dy)) & (np.abs(zoom - zoom[m]) <= 0.6) & (np.abs(off) <= 0.5)
        if ok.sum() >= need:
            return True
    return False


def descriptor_rows(images: DataFrame) -> DataFrame:
    """k, s0, s1, f1, p: each descriptor of each image under each of its bands; s0 and s1 are its bits with the band's half first,
    p its number and place."""
    rows = images.select("f1", F.posexplode("corners").alias("at", "c"))
    entries = []
    for i in range(TABLES):
        own, other = ("c.b0", "c.b1") if i < TABLES // 2 else ("c.b1", "c.b0")
        band = F.shiftright(F.col(own), 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        k = F.shiftleft(F.lit(i).cast("long"), 32).bitwiseOR(band)
        entries.append(F.struct(k.alias("k"), F.col(own).alias("s0"), F.col(other).alias("s1")))
    p = F.shiftleft((F.col("at") % 0x7FFF).cast("long"), 48).bitwiseOR(F.col("c.place"))
    return rows.select(F.explode(F.array(*entries)).alias("e"), "f1", p.alias("p")).select("e.k", "e.s0", "e.s1", "f1", "p")


def met(rows: DataFrame) -> DataFrame:
    """a, b, at: the neighbours in the sorted buckets, of different images and with few differing bits; `at` packs the slot (one of
    64) of a's corner and the two cells of the transform."""
    order = ["k", "s0", "s1", "f1"]
    src = rows.select(*order, "p").repartitionByRange(common.n_parts(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches):
        before = [np.zeros(0, np.int64)] * 5
        for batch in batches:
            cols = [np.concatenate([b, c.to_numpy()]) for b, c in zip(before, batch.columns)]
            n, old = len(cols[0]), len(before[0])
            k, s0, s1, f1, p = cols
            # differing bits from each row to the rows behind it; rows carried over meet new rows only
            differ = np.full((NEAR, n), 255, np.uint8)
            for step in range(1, min(NEAR, n - 1) + 1):
                i = np.arange(max(0, old - step), n - step)
                j = i + step
                bits = np.bitwise_count((s0[i] ^ s0[j]).view(np.uint64)) + np.bitwise_count((s1[i] ^ s1[j]).view(np.uint64))
                differ[step - 1, i] = np.where((k[i] == k[j]) & (f1[i] != f1[j]) & (bits <= MET_BITS), bits, 255)
            back = np.full((NEAR, n), 255, np.uint8)
            for step in range(1, min(NEAR, n - 1) + 1):
                back[step - 1, step:] = differ[step - 1, :-step]
            ahead, behind = differ.argmin(0), back.argmin(0)
            i, j = np.flatnonzero(differ.min(0) < 255), np.flatnonzero(back.min(0) < 255)
            both = np.unique(np.concatenate([i * n + i + ahead[i] + 1, (j - behind[j] - 1) * n + j]))
            i, j = both // max(n, 1), both % max(n, 1)
            swap = f1[i] > f1[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            c0, c1 = _cells(p[i], p[j])
            out = f1[i], f1[j], (p[i] >> 48 & 63) << 58 | c0 << 29 | c1
            before = [c[-NEAR:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["a", "b", "at"])

    return src.mapInArrow(run, "a long, b long, at long")


def votes(pairs: DataFrame) -> DataFrame:
    """a, b and votes, from `met`: the most different corners in one cell, if there are `PROBE`; one shuffle by pair."""
    rows = pairs.repartition(common.n_parts(pairs.sparkSession), "a", "b")
    slot, cell = F.shiftrightunsigned("at", 58).cast("int"), lambda by: F.shiftrightunsigned("at", by).bitwiseAND(F.lit((1 << 29) - 1)).cast("int")
    # a bit for each slot, so that a corner votes once however many tables it meets in
    rows = rows.select("a", "b", F.call_function("shiftleft", F.lit(1).cast("long"), slot).alias("corner"), F.explode(F.array(cell(29), cell(0))).alias("cell"))
    rows = rows.groupBy("a", "b", "cell").agg(F.bit_or("corner").alias("corners")).groupBy("a", "b")
    return rows.agg(F.max(F.bit_count("corners")).alias("votes")).where(F.col("votes") >= PROBE)


def compared(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """The pairs whose images are copies by all of their descriptors, each image as a struct (d, f1)."""
    side = lambda x: images.select(F.col("f1").alias(x), F.col("d").alias(f"{x}_d"), F.col("corners").alias(f"{x}_c"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a_d", "a", "b_d", "b", "a_c", "b_c")

    def sides(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, edges = column.values, column.offsets.to_numpy()
        place, b0, b1 = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("place", "b0", "b1"))
        bits = np.stack([b0, b1], 1).astype(np.int64).view(np.uint64).reshape(-1, 2)
        return [(place[i:j], bits[i:j]) for i, j in zip(edges[:-1], edges[1:])]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ok = pa.array([agreeing(x, y) for x, y in zip(sides(part.column(4)), sides(part.column(5)))], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(i).filter(ok) for i in range(4)], names=["a_d", "a", "b_d", "b"])

    node = lambda x: F.struct(F.col(f"{x}_d").alias("d"), F.col(x).alias("f1")).alias(x)
    return rows.mapInArrow(run, "a_d long, a long, b_d long, b long").select(node("a"), node("b"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs that aren't in one class yet."""
    root = lambda x: roots.select(F.col("node.f1").alias(x), F.col("root.f1").alias(f"{x}_root"))
    rows = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return rows.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).drop("a_root", "b_root")


class _Side:
    """The images of a block in the order of f1, and their corners."""

    def __init__(self, f1: np.ndarray, d: np.ndarray, own: np.ndarray, sizes: np.ndarray, place: np.ndarray, bits: np.ndarray):
        self.f1, self.d, self.own, self.sizes, self.place = f1, d, own, sizes, place
        self.halves = np.ascontiguousarray(bits.T)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.image = np.repeat(np.arange(len(f1), dtype=np.int32), sizes)
        self.corner = ((np.arange(len(place)) - self.first[self.image]) % 0x7FFF & 63).astype(np.uint8)

    def part(self, i: int, j: int) -> _Side:
        at = slice(self.first[i], self.first[j])
        return _Side(self.f1[i:j], self.d[i:j], self.own[i:j], self.sizes[i:j], self.place[at], self.halves[:, at].T)

    def band(self, i: int) -> np.ndarray:
        return self.halves[i // 2] >> np.uint64(32 * (i % 2)) & np.uint64(0xFFFFFFFF)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.first[i], self.first[i + 1])
        return self.place[at], self.halves[:, at].T


def candidates(left: _Side, right: _Side):
    """Pairs (i, j) of images of two classes, the left one's f1 smaller, with `PROBE` corners in one cell of transforms: all corners
    with an equal band and at most `MET_BITS` different bits meet.  About `AT_ONCE` meetings are in memory at a time."""
    if not len(left.f1) or not len(right.f1):
        return
    tables = []
    for band in range(TABLES):
        key = right.band(band)
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([first, [len(key)]])).astype(np.int32)
        own = left.band(band)
        by, at = np.argsort(own), np.empty(len(own), np.int64)
        at[by] = np.searchsorted(key[first], own[by])
        at = np.minimum(at, len(first) - 1)
        tables.append((order, right.halves[:, order], right.image[order], first[at].astype(np.int32), np.where(key[first[at]] == own, count[at], np.int32(0))))
        del key, order, first, count, own, by, at
    per = np.add.reduceat(sum(n.astype(np.int64) for *_, n in tables), left.first[:-1])
    if per.max() > 2 * AT_ONCE and len(right.f1) > 1:
        half = len(right.f1) // 2
        for i, j in ((0, half), (half, len(right.f1))):
            for x, y in candidates(left, right.part(i, j)):
                yield x, y + i
        return
    total, n, a = np.cumsum(per), len(right.f1), 0
    apart, low32 = left.f1[-1] < right.f1[0], np.uint64(0xFFFFFFFF)
    while a < len(left.f1):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right"))
        b = min(max(b, a + 1), a + max(1, (1 << 20) // n), len(left.f1))
        begin, end = left.first[a], left.first[b]
        found = []
        for band, (order, halves, image, low, count) in enumerate(tables):
            m = count[begin:end].astype(np.int64)
            i = np.repeat(np.arange(begin, end), m)
            at = np.arange(len(i)) + np.repeat(low[begin:end] - np.cumsum(m) + m, m)
            u, v = (np.repeat(x[begin:end], m) ^ y[at] for x, y in zip(left.halves, halves))
            ok = np.bitwise_count(u) + np.bitwise_count(v) <= MET_BITS
            # two corners with several equal bands meet in the first of them
            for earlier in range(band):
                ok &= ((u, v)[earlier // 2] >> np.uint64(32 * (earlier % 2)) & low32) != 0
            k = np.flatnonzero(ok)
            i, at = i[k], at[k]
            p, q = left.image[i], image[at]
            ok = left.own[p] != right.own[q]
            if not apart:
                ok &= left.f1[p] < right.f1[q]
            i, at, pair = i[ok], at[ok], ((p.astype(np.int64) - a) * n + q)[ok]
            found.append((i, order[at], pair))
        i, j, pair = (np.concatenate(x) for x in zip(*found))
        # the transforms of pairs with fewer meetings needn't be told
        k = np.flatnonzero((np.bincount(pair, minlength=1) >= PROBE)[pair])
        i, j, pair = i[k], j[k], pair[k]
        hit = []
        for cell in _cells(left.place[i], right.place[j]):
            # equal pairs and cells side by side, each corner of the left image once
            key = np.sort(pair << 34 | (cell & (1 << 28) - 1) << 6 | left.corner[i])
            key = key[np.concatenate([[True], key[1:] != key[:-1]])] >> 6 if len(key) else key
            hit.append(key[PROBE - 1 :][key[PROBE - 1 :] == key[: max(0, len(key) - PROBE + 1)]] >> 28)
        hit = np.unique(np.concatenate(hit))
        yield a + hit // n, hit % n
        a = b


@functools.lru_cache(maxsize=1)
def _zooms() -> tuple[np.ndarray, np.ndarray]:
    """By the scales (4 bits each) of two matches, whether their zooms are near enough to follow each other; and zooms by both scales
    and the turn, as `_turned` has them."""
    sizes = np.zeros(16)
    sizes[: len(SCALES)] = np.log2(np.array(SCALES))
    zoom = (sizes[:, None] - sizes[None]).reshape(-1)
    return (np.abs(zoom[:, None] - zoom[None]) <= 0.6 + 1e-6).reshape(-1), np.exp2(np.repeat(zoom, 32))


def _may_follow(pair: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For n pairs, in whose order the matches of places a with places b are, whether `need` matches follow one of them as `agreeing`
    asks.  A match at most two scales and two orientation steps away may follow; a third step is too far."""
    zooms, out = 2 * len(SCALES) - 1, np.zeros(n, bool)
    for low in range(0, n, 256):
        these = slice(*np.searchsorted(pair, [low, low + 256]))
        p, pa_, pb, m = pair[these] - low, a[these], b[these], min(256, n - low)
        zoom, turn = (pb >> 8 & 0xF) - (pa_ >> 8 & 0xF) + len(SCALES) - 1, pb - pa_ & 31
        # two zooms and, around the circle, two turns on either side
        count = np.bincount((p * (zooms + 4) + zoom + 2) * 36 + turn + 2, minlength=m * (zooms + 4) * 36).astype(np.uint16).reshape(m, zooms + 4, 36)
        count[:, :, :2], count[:, :, 34:] = count[:, :, 32:34], count[:, :, 2:4]
        count = sum(count[:, i : i + zooms] for i in range(5))
        count = sum(count[:, :, i : i + 32] for i in range(5))
        led = np.flatnonzero(count[p, zoom, turn] >= need[low : low + m][p])
        sizes = np.bincount(p, minlength=m)
        first = np.cumsum(sizes) - sizes
        both, turn = ((pa_ >> 8 & 0xF) << 4 | pb >> 8 & 0xF), turn.astype(np.int8)
        (xa, ya, _, _), (xb, yb, _, _) = _geometry(pa_), _geometry(pb)
        kc, ks, k = (z[pb - pa_ & 31 | both << 5] for z in (*_turned()[:2], _zooms()[1]))
        at = 0
        total = np.cumsum(sizes[p[led]])
        while at < len(led):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
            lead = led[at:to]
            size = sizes[p[lead]]
            by = np.repeat(np.arange(len(lead)), size)
            row = lead[by]
            i = np.arange(len(row)) + np.repeat(first[p[lead]] - np.cumsum(size) + size, size)
            # turns and zooms are told by steps; leads with too few matches of theirs need no places
            ok = np.flatnonzero(((turn[i] - turn[row] + 2 & 31) <= 4) & _zooms()[0][both[i] << 8 | both[row]])
            enough = np.bincount(by[ok], minlength=len(lead)) >= need[low : low + m][p[lead]]
            ok = ok[enough[by[ok]]]
            row, i, by = row[ok], i[ok], by[ok]
            dx, dy = xa[i] - xa[row], ya[i] - ya[row]
            ex, ey = xb[i] - xb[row] - (kc[row] * dx - ks[row] * dy), yb[i] - yb[row] - (ks[row] * dx + kc[row] * dy)
            ok = np.hypot(ex, ey) <= 3 + 0.1 * k[row] * np.hypot(dx, dy) + 1e-6
            led_ok = np.bincount(by[ok], minlength=len(lead)) >= need[low : low + m][p[lead]]
            out[low + p[lead[led_ok]]] = True
            at = to
    return out


def _few(flags: np.ndarray) -> np.ndarray:
    """The places of flags of which few are set, eight at a time; their number is a multiple of eight."""
    words = np.flatnonzero(flags.view(np.uint64))
    k = np.flatnonzero(flags.reshape(-1, 8)[words])
    return words[k >> 3] * 8 + (k & 7)


def agreed(left: _Side, right: _Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`agreeing` of the images x of one block with the images y of another, for many pairs in the order of x: a pair whose mutually
    nearest corners can't follow one transform is left out before it is looked at on its own."""
    need = np.maximum(CONSENSUS, np.ceil(LEAST_SHARE * np.minimum(left.sizes[x], right.sizes[y])).astype(int))
    out, found = np.zeros(len(x), bool), []
    mean = max(1, len(right.place) // len(right.f1))
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)
    differ, bits, more = (np.zeros(0, kind) for kind in (np.uint64, np.uint8, np.uint8))
    for own, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
        corners = slice(left.first[x[own]], left.first[x[own] + 1])
        n, halves, places = corners.stop - corners.start, left.halves[:, corners, None], left.place[corners]
        few = max(1, COMPARED // (int(n) * mean))
        for begin in range(own, stop, few):
            these = y[begin : min(stop, begin + few)]
            sizes = right.sizes[these]
            first = np.cumsum(sizes) - sizes
            image = np.repeat(np.arange(len(these)), sizes)
            at = np.arange(len(image)) + (right.first[these] - first)[image]
            m = len(at)
            if len(bits) < n * m + 8:
                differ, bits, more = (np.empty(n * m + 8, z.dtype) for z in (differ, bits, more))
            d, e, z = (buffer[: n * m].reshape(n, m) for buffer in (bits, more, differ))
            for half, out_bits in enumerate((d, e)):
                np.bitwise_count(np.bitwise_xor(halves[half], right.halves[half][at], out=z), out=out_bits)
            d += e
            least = d.min(0)
            least[least > MOST_BITS] = 255
            same = more.view(bool)
            np.equal(d, least, out=same[: n * m].reshape(n, m))
            same[n * m : n * m + 8] = False
            k = _few(same[: -(-n * m // 8) * 8])
            i = k // m
            j = k - i * m
            k = np.flatnonzero(least[j] == np.minimum.reduceat(d, first, axis=1)[i, image[j]])
            i, j = i[k], j[k]
            found.append((begin + image[j], places[i], right.place[at[j]]))
    if found:
        pair, a, b = (np.concatenate(c) for c in zip(*found))
        k = np.flatnonzero((np.bincount(pair, minlength=len(x)) >= need)[pair])
        k = k[np.argsort(pair[k], kind="stable")]
        for k in np.flatnonzero(_may_follow(pair[k], len(x), a[k], b[k], need)).tolist():
            out[k] = agreeing(left[x[k]], right[y[k]])
    return out


def rest(images: DataFrame, roots: DataFrame) -> DataFrame:
    """The copies among all pairs of images of two classes that have `PROBE` met corners, however full a bucket is; each image as a
    struct (d, f1).

    Images are dealt into blocks of about `BLOCK` corners by ranges of f1, a hash, and every two blocks meet in one group: rows
    grow with the square of the images divided by a block's, and a group holds two blocks."""
    own = roots.select(F.col("node.f1").alias("f1"), F.col("root.f1").alias("class"))
    total = images.agg(F.sum(F.size("corners"))).first()[0] or 0
    blocks = min(1 << 15, max(LEAST_BLOCKS, -(-total // BLOCK)))
    block = F.floor((F.shiftright("f1", 48) + 32768) * blocks / 65536).cast("int")
    rows = images.join(own, "f1", "left").select(
        block.alias("block"), "f1", "d", F.coalesce("class", "f1").alias("class"), *[F.col(f"corners.{x}").alias(x) for x in ("place", "b0", "b1")]
    )
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = rows.withColumn("tile", F.explode(F.transform(other, lambda x: F.least(x, "block").cast("long") * blocks + F.greatest(x, "block"))))

    def run(t: pa.Table) -> pa.Table:
        i, j = divmod(t["tile"][0].as_py(), blocks)
        order, block = np.argsort(t["f1"].to_numpy(), kind="stable"), t["block"].to_numpy()

        def side(k: int) -> _Side:
            part = t.take(pa.array(order[block[order] == k]))
            lists = [part[x].combine_chunks() for x in ("place", "b0", "b1")]
            place, b0, b1 = (x.flatten().to_numpy() for x in lists)
            sizes = lists[0].value_lengths().to_numpy().astype(np.int64)
            return _Side(*[part[x].to_numpy() for x in ("f1", "d", "class")], sizes, place, np.stack([b0, b1]).view(np.uint64).T)

        left = side(i)
        right = left if i == j else side(j)
        del t
        made = []
        for x, y in candidates(left, right):
            ok = agreed(left, right, x, y)
            made.append((x[ok], y[ok]))
        x, y = (np.concatenate(c).astype(np.int64) for c in zip(*made)) if made else [np.zeros(0, np.int64)] * 2
        return pa.table({"a_d": left.d[x], "a": left.f1[x], "b_d": right.d[y], "b": right.f1[y]})

    # tiles cost alike, however few bytes they are: a task for nearly every one
    tiles = blocks * (blocks + 1) // 2
    rows = rows.repartition(max(common.n_parts(images.sparkSession), min(4 * tiles, 2000)), "tile")
    made = rows.groupBy("tile").applyInArrow(run, "a_d long, a long, b_d long, b long")
    node = lambda x: F.struct(F.col(f"{x}_d").alias("d"), F.col(x).alias("f1")).alias(x)
    return made.select(node("a"), node("b"))


def classes(images: DataFrame) -> DataFrame:
    """A written table (node, root), structs (d, f1), of the images that have copies; images: f1 (one row an image), d and corners."""
    from pyspark.sql import Window

    edges = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    pairs = common.materialize(votes(met(descriptor_rows(images))), "pairs")
    likeliest = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))
    links = common.materialize(compared(pairs.withColumn("r", likeliest).where("r <= 2"), images), "agree")
    roots = connected(links)
    more = common.finish(compared(_across(pairs, roots), images), "agree", pairs)
    if not more.isEmpty():
        roots, old = connected(links.union(more)), roots
        common.drop_tables(old)
    common.drop_tables(links, more)
    # what others hid in full buckets, and what met fewer times than it has to
    links = common.materialize(rest(images, roots), "agree")
    if not links.isEmpty():
        roots, old = connected(links.union(edges(roots))), roots
        common.drop_tables(old)
    common.drop_tables(links)
    return roots


def copies(df: DataFrame, image: str = "image", image_id: str = "image_id") -> DataFrame:
    """image_id, n_corners and class_id (the smallest id of the image's class) of every image."""
    ident = F.coalesce(F.col(image_id).cast("long"), F.lit(_NO_ID))
    found = common.materialize(descriptors(df, {"d": ident}, image), "corners")
    # images with equal bytes are one; any of their rows describes it
    own = found.where(F.col("n_corners") > 0).groupBy("f1").agg(F.min("d").alias("d"), F.first("corners").alias("corners"))
    own = common.materialize(own, "images")
    roots = classes(own)
    per = own.select("f1", "d").join(roots.select(F.col("node.f1").alias("f1"), F.col("root.d").alias("root")), "f1", "left")
    per = per.select("f1", F.coalesce("root", "d").alias("class"))
    empty = F.col("n_corners") == 0
    back = lambda c: F.when(c != _NO_ID, c)
    made = found.select("d", "f1", "n_corners").join(per, "f1", "left").select(
        back(F.col("d")).alias("image_id"), "n_corners", back(F.when(empty, F.col("d")).otherwise(F.col("class"))).alias("class_id")
    )
    return common.finish(made, "copies", found, own, roots)


# ---------------------------------------------------------------------------------------------------------------------
# a media column for the tables at hand

SIDE = 72


@functools.lru_cache(maxsize=1)
def _patterns(size: int) -> np.ndarray:
    """`size` pictures of noise at three scales, each of unit variance."""
    rng = np.random.default_rng(11)
    made = np.zeros((size, SIDE, SIDE), np.float32)
    for r in (1, 3, 7):
        x = _box(_box(rng.normal(0, 1, (size, SIDE, SIDE)).astype(np.float32), r), r)
        made += x / x.std()
    return (made / made.std()).reshape(size, -1)


def rotated(x: np.ndarray, degrees: float) -> np.ndarray:
    """An image turned about its middle, within its frame, edges repeated."""
    h, w = x.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, z = np.mgrid[:h, :w]
    y, z = y - (h - 1) / 2, z - (w - 1) / 2
    ys, xs = np.clip(s * z + c * y + (h - 1) / 2, 0, h - 1.001), np.clip(c * z - s * y + (w - 1) / 2, 0, w - 1.001)
    y0, x0 = ys.astype(int), xs.astype(int)
    fy, fx = ys - y0, xs - x0
    return (x[y0, x0] * (1 - fx) + x[y0, x0 + 1] * fx) * (1 - fy) + (x[y0 + 1, x0] * (1 - fx) + x[y0 + 1, x0 + 1] * fx) * fy


def edited(grey: np.ndarray, kind: int, seed: int) -> np.ndarray:
    """A copy: cropped and brightened, with noise, at a smaller or larger scale, or turned."""
    if kind == 0:
        return grey[4:-3, 6:-2] * 0.9 + 12
    if kind == 1:
        return grey + np.random.default_rng(seed).normal(0, 6, grey.shape)
    if kind == 2:
        return _resized(grey[None], 0.8)[0]
    if kind == 3:
        return _resized(grey[None], 1.25)[0]
    return rotated(grey, 10)


def rendered(embeddings: DataFrame) -> DataFrame:
    """image_id and image: a picture of each vector, and of every seventh vector a copy by one of the five edits as well.

    A picture's id is twice the vector's; a copy's is one more."""
    src = embeddings.select(F.col("vec_id").cast("long").alias("v"), F.col("embedding").cast("array<float>").alias("e"))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids, images = [], []
                for v, e in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(None if v is None else 2 * v)
                    if e is None:
                        images.append(None)
                        continue
                    grey = np.clip(128 + 45 * (np.array(e, np.float32) @ _patterns(len(e))), 0, 255).reshape(SIDE, SIDE)
                    images.append(pgm(grey))
                    if v is not None and v % 7 == 0:
                        ids.append(2 * v + 1)
                        images.append(pgm(edited(grey, v // 7 % 5, v)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], names=["image_id", "image"])

    return src.mapInArrow(run, "image_id long, image binary")
