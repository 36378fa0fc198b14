import numpy as np
import pyarrow as pa
import pytest

from newsflow.llm.vectors import FURTHEST, column_sums, from_limbs, limbs, pack, roomy, unpack, whole


def test_only_finite_vectors_are_kept_and_floors_go_down():
    vectors = [[0.5, -0.3], None, [1.0, None], [float("nan"), 0.0], [float("-inf"), 1.0], [], [2.0]]
    rows, size, values = whole(pa.array(vectors, pa.list_(pa.float32())), 4.0)
    assert (rows.tolist(), size.tolist(), values.tolist()) == ([0, 5, 6], [2, 0, 1], [2, -2, 8])


def test_a_slice_is_read_from_where_it_starts():
    vectors = pa.array([[1.0], [2.0, 3.0], None, [4.0]], pa.list_(pa.float64())).slice(1)
    rows, size, values = whole(vectors, 1.0)
    assert (rows.tolist(), size.tolist(), values.tolist()) == ([0, 2], [2, 1], [2, 3, 4])


def test_huge_entries_stop():
    _, _, values = whole(pa.array([[3e38, -3e38]], pa.list_(pa.float32())), 4096.0)
    assert values.tolist() == [FURTHEST, -FURTHEST]


@pytest.mark.parametrize("top", [1, 127, 32767, 32768, 2**31 - 1, 2**31, 2**52])
def test_rows_are_packed_as_narrow_as_they_can_be(top):
    rows = np.array([[0, -1], [top, 3], [-top - 1, 0], [1, 2]])
    packed = pack(np.full(4, 2), rows.reshape(-1))
    assert unpack(packed, 2).tolist() == rows.tolist()
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    assert [len(x) for x in packed.to_pylist()] == [4, 2 * width, 2 * width, 4]


def test_rows_without_entries():
    packed = pack(np.array([0, 1, 0]), np.array([5]))
    assert packed.to_pylist() == [b"", b"\x05\x00", b""]
    assert unpack(packed.take(pa.array([0, 2])), 0).shape == (2, 0)


def test_sums_are_exact():
    values = np.array([[2**52, -(2**52)], [2**52, -1], [7, 5]])
    want = [2**53 + 7, -(2**52) + 4]
    assert column_sums(values) == want == column_sums(values.astype(object))
    assert column_sums(values[:0]) == [0, 0]
    assert roomy(values, 20).dtype == object and roomy(values, 53).dtype == np.int64
    for n in (0, -1, 2**100 + 17, -(2**100) + 3):
        assert from_limbs(x[0].as_py() for x in limbs([n], 5)) == n
