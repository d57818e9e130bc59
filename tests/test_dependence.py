import numpy as np
import pytest

from gaugeworks.operators import surrogates as sg
from gaugeworks.problem import Gaussian, Problem

MODEL = Problem({"a": Gaussian(), "b": Gaussian()}, correlation=np.array([[1, 0.5], [0.5, 1]]))


def test_kernel_indices_of_correlated_inputs_are_conditional(spark):
    """A kernel at one point: what an input tells alone and what the other leaves differ by what they share."""
    model = sg.Kernel(MODEL, np.full((1, 2), 0.5), np.ones(1), 0.0, 1.0)
    got = sg.kernel_indices(model, spark, 64, 32, 512).toPandas().set_index("param")
    assert (got.s_tc > got.s_tu).all() and (got.s_u <= got.s_tu + 1e-12).all() and (got.s_c > 0).all()


@pytest.mark.parametrize("sizes", [(None, 8, 8), (8, 0, 8), (8, 8, 2.5)])
def test_sizes_are_checked(spark, sizes):
    with pytest.raises(ValueError, match="whole numbers"):
        sg.kernel_indices(sg.Kernel(MODEL, np.full((1, 2), 0.5), np.ones(1), 0.0, 1.0), spark, *sizes)
