"""Special functions against known values, and p-values against published tables."""

import math

import numpy as np
import pytest

from wavepanel.functions import numeric as N

# Published statistics (chi-squared, df, p) of the survival, height,
# fruit-probability and fruit-count tables, without and with species.
PUBLISHED = [
    (85.8686116821617, 1, 1.92296993754174e-20), (82.9271327305789, 2, 9.83109578598984e-19),
    (8.06452403688172, 1, 0.00451403315379744), (29.1043460406033, 1, 6.85829617927798e-08),
    (6.6683973891088, 2, 0.0356431358101926), (4.13341461888047, 1, 0.0420444329843227),
    (52.9375916022884, 2, 3.19703978597467e-12), (1.15301160132287, 1, 0.282919602301502),
    (26.3918671230042, 2, 1.85814187499548e-06),
    (362.789713314576, 4, 3.03547943989016e-77), (419.759908302034, 2, 7.0842527936118e-92),
    (182.64161044262, 1, 1.28431707915719e-41), (113.08996606211, 1, 2.06203040976968e-26),
    (9.29895338915891, 1, 0.00229284809499215), (278.273165198351, 8, 1.71917433075417e-55),
    (5.26920032512493, 4, 0.260774024246716), (5.05296346865289, 2, 0.079939775478634),
    (2.29242588710404, 4, 0.682148381826143), (2.37433176473108, 2, 0.305084685857502),
    (2.88801146601818, 4, 0.576737909124846), (0.140130921925639, 2, 0.932332786506445),
    (233.550006875927, 4, 2.27150401216413e-49), (178.608633968881, 2, 1.6429635311806e-39),
    (0.0129993433762365, 1, 0.909226169858712), (9.28401052010673, 1, 0.00231162755734467),
    (47.9192310899629, 8, 1.0237066835141e-07), (3.37162012282056, 2, 0.185294271405737),
    (1.79773400676038, 4, 0.77289690514856), (0.0351131449634181, 2, 0.982596646161878),
    (1.53228362955224, 4, 0.820907853281834),
    (34.4897469289059, 2, 3.24075808568592e-08), (11.7748170111113, 1, 0.000600374142038052),
    (11.1009197495588, 1, 0.000862849163154311), (12.7500069854944, 1, 0.000356007833606443),
    (86.1128872817718, 1, 1.69951673367942e-20), (83.8826172036737, 2, 6.0970690069946e-19),
    (11.0858029992206, 1, 0.000869911450047208), (31.1489174880327, 1, 2.38972590825383e-08),
    (1.14735692946567, 1, 0.284103121062964), (6.74080863639415, 2, 0.0343757357978173),
    (3.98571898003229, 1, 0.045887512994567), (51.1909363542519, 2, 7.65648452262654e-12),
    (1.12929923023705, 1, 0.287924863694375), (25.1769955774165, 2, 3.41102478380039e-06),
    (370.312642235866, 4, 7.20293070424446e-79), (428.5537760272, 2, 8.72428684548035e-94),
    (196.796039420994, 1, 1.04480543912348e-44), (119.272284783754, 1, 9.12966554030712e-28),
    (13.576155111396, 1, 0.000229076976603697), (10.5838707225516, 1, 0.00114078558637284),
    (285.464278901851, 8, 5.09088422251577e-57), (5.4061064951532, 4, 0.248106902762427),
    (4.16064025083909, 2, 0.124890225262747), (2.3214720419934, 4, 0.676862514712718),
    (1.79758487359688, 2, 0.407060914851674), (2.85830524735983, 4, 0.581810700123869),
    (0.609189161739359, 2, 0.73742227889572),
    (233.655635037977, 4, 2.15561577023292e-49), (178.726587492196, 2, 1.54886883504856e-39),
    (0.00795303774594913, 1, 0.928939014133925), (8.71867537539168, 1, 0.00314966802065614),
    (0.233190633052402, 1, 0.629168048248303), (47.9641360551288, 8, 1.0036727792559e-07),
    (3.42098647228505, 2, 0.180776605068326), (1.78560739093666, 4, 0.775114492062557),
    (0.0321826457668521, 2, 0.984037450814381), (1.52617542844411, 4, 0.821994923920906),
    (33.423366513487, 2, 5.52342140048416e-08), (11.7980157490581, 1, 0.00059293883961),
    (9.6251335877051, 1, 0.001919324888752), (12.9608871439427, 1, 0.00031806642603),
    (0.009759609995141, 1, 0.92130442220044),
]


@pytest.mark.parametrize("chisq,df,p", PUBLISHED)
def test_chi2_tail_matches_published(chisq, df, p):
    assert N.chi2_tail(chisq, df) == pytest.approx(p, rel=2e-9)


# Published count model, estimate, standard error, z.
COUNT_COEFFICIENTS = [
    (2.483298, 0.414940, 5.985, 2.17e-09), (-0.287587, 0.128239, -2.243, 0.024923),
    (1.786840, 0.304257, 5.873, 4.29e-09), (1.517473, 0.356920, 4.252, 2.12e-05),
    (0.993762, 0.289605, 3.431, 0.000600), (0.003860, 0.001159, 3.332, 0.000863),
    (-0.922804, 0.258437, -3.571, 0.000356),
]


@pytest.mark.parametrize("estimate,se,z,p", COUNT_COEFFICIENTS)
def test_z_and_p_match_published_coefficients(estimate, se, z, p):
    assert estimate / se == pytest.approx(z, abs=2e-3)
    assert N.normal_two_sided(z) == pytest.approx(p, rel=6e-3)


def test_gamma_functions():
    x = np.array([0.01, 0.5, 1, 2.5, 9.99, 100, 1e5])
    assert N.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    h = 1e-5
    assert N.digamma(x[1:5]) == pytest.approx((N.lgamma(x[1:5] + h) - N.lgamma(x[1:5] - h)) / (2 * h), rel=1e-6)
    assert float(N.digamma(1.0)) == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert float(N.trigamma(1.0)) == pytest.approx(math.pi**2 / 6, abs=1e-12)


def test_distribution_functions():
    assert N.normal_cdf([-1.959963984540054, 0.0, 3.0]) == pytest.approx([0.025, 0.5, 0.9986501019683699], rel=1e-10)
    assert N.gamma_cdf(1.0, [0.3, 5.0]) == pytest.approx([1 - math.exp(-0.3), 1 - math.exp(-5)], rel=1e-12)
    assert N.gamma_cdf(200.0, 200.0) == pytest.approx(0.509404, abs=1e-5)
    assert float(N.beta_cdf(0.3, 2, 5)) == pytest.approx(0.579825, abs=1e-9)
    # t with 1 df is Cauchy; F(1, n) is t squared
    assert N.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-10)
    assert N.f_tail(4.0, 1, 7) == pytest.approx(N.t_two_sided(2.0, 7), rel=1e-10)


def test_count_distributions_sum_their_masses():
    k, mu = 1.7, 6.3
    mass = [math.exp(math.lgamma(y + k) - math.lgamma(k) - math.lgamma(y + 1) + k * math.log(k / (k + mu))
                     + y * math.log(mu / (k + mu))) for y in range(30)]
    assert N.negbin_cdf(np.arange(30), mu, k) == pytest.approx(np.cumsum(mass), rel=1e-9)
    assert N.negbin_cdf(-1, mu, k) == 0
    pois = [math.exp(-mu) * mu**y / math.factorial(y) for y in range(20)]
    assert N.poisson_cdf(np.arange(20), mu) == pytest.approx(np.cumsum(pois), rel=1e-9)


def test_ks_tail_limits():
    assert N.ks_tail(1e-6, 100) == 1.0
    assert N.ks_tail(0.136, 100) == pytest.approx(0.05, abs=0.01)
