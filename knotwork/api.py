"""Everything a user of the models needs, in one import."""

from .functions.families import GAMMALS, GAUMLSS, MULNOMLSS, Binomial, ExtendedFamily, Family, GAMLSSFamily, Gamma, Gaussian, InvGauss, Poisson, ScaledT
from .functions.links import LOG, Identity, Link, LOGb, Logit
from .operators.cluster import bin_counts, bin_edges, cluster_series
from .operators.encode import Encoding, encode, lagged, learn, na_mask
from .operators.partials import cross_pairs, gather
from .plans.arrow import ArrowGAMM
from .plans.gamm import GAMM
from .plans.hazard import PropHaz
from .plans.hsmm import HSMM, HSMMFamily
from .plans.inference import RhoPrior, UniformRhoPrior, aic, compare_CDL, convergence, correct_covariance, edf1, estimate_vp, print_parametric_terms, print_smooth_terms, refits, sample_posterior, smooth_p_values, summary_parametric, summary_smooth
from .plans.kinds import ConstType, Extension, Method, Residual
from .plans.joint import GAMMLSS, GSMM, Adapter, FamilyAdapter, GSMMFamily, MultiGauss
from .plans.model import read_mmat
from .plans.terms import Formula, f, fs, i, irf, l, lhs, li, ri, rs
from .sources.readers import read_cov, read_cov_no_cor, read_csv, read_dtype, read_unique
from .streaming.scoring import Running, score_stream

__all__ = [n for n in dir() if not n.startswith("_")]
