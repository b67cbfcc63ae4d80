"""All operators by name, for `from tessera.api import *`."""

from .functions.breaks import hinge15_breaks, hinge30_breaks, natural_breaks, percentile_breaks, quantile_breaks, stddev_breaks
from .functions.rates import eb_rates, eb_rates_standardization, is_binary
from .functions.scale import scaled
from .operators.clustering import (
    azp_greedy, azp_sa, azp_tabu, clustering_stats, compactness, diameter, fragmentation, is_spatially_constrained, join_count_ratio, make_spatial, maxp_greedy, maxp_sa, maxp_tabu, minimum_spanning_tree, redcap, schc, skater,
    spatial_validation, subcluster_fragmentation, sums_of_squares,
)
from .operators.lisa import (
    exact_joins, lisa_bo, lisa_clusters, lisa_colors, lisa_fdr, lisa_labels, lisa_num_nbrs, lisa_pvalues, lisa_values, local_bijoincount, local_bimoran, local_g, local_geary, local_gstar, local_joincount, local_moran, local_moran_eb,
    local_multigeary, local_multijoincount, local_multiquantilelisa, local_quantilelisa, permuted,
)
from .operators.match import attribute_nearest, neighbor_match_test
from .operators.weights import (
    Weights, as_matrix, create_weights, distance_weights, get_neighbors, get_neighbors_weights, has_isolates, is_symmetric, kernel_knn_weights, kernel_weights, knn_weights, max_neighbors, mean_neighbors, median_neighbors,
    min_distthreshold, min_neighbors, queen_weights, rook_weights, set_neighbors, set_neighbors_with_weights, spatial_lag, update_weights, weights_sparsity, weights_stats, weights_summary,
)
from .sources.shapefile import open_shapefile
from .sources.weights_io import read_gal, read_gwt, read_swm, save_weights
from .sources.wkb import as_data_frame, as_layer, layer_info, map_type, point_layer, undefined_values, with_wkb

__all__ = [n for n in dir() if not n.startswith("_")]
