"""Parameter grids of the presets. Fixed values; shared lists are named once.

Left out are a library's internal routines (solver, neighbour index, warm start) and settings
without a counterpart here, although they change the model: tree splitter, cost-complexity
pruning, the deviation detector's other measures, the LOCI detector's smallest neighbourhood.
"""
from __future__ import annotations

N = [10, 50, 100, 150, 200]
LONG_N = list(range(50, 501, 50))
RATES = [0.001, 0.01, 0.1, 1]
FEATURES = ["auto", "log2", 5, 10, 15, 20]
MORE_FEATURES = [*FEATURES, 30, 40, 50, 60]
CRITERIA = ["gini", "entropy"]
STRATEGIES = ["not minority", "majority", "auto"]
ALGORITHMS = ["SAMME", "SAMME.R"]
ODD_TENTHS = [0.1, 0.3, 0.5, 0.7, 0.9]
NEAR = [3, 5, 7, 10, 15, 20]
SYNTH_NEAR = [3, 4, 5, 10, 15]
SVC_RANGE = {"gamma": [0.001, 0.01, 0.1, 1, 10, 100], "C": [0.01, 0.1, 1, 5, 10, 100]}
CLASS_WEIGHTS = ["balanced", *[{0: w, 1: 1} for w in (100, 75, 50, 25, 10)], *[{0: 1, 1: w} for w in (1, 10, 25, 50, 75, 100)]]
XGB = {"gamma": [0.001, 0.01, 0.1, 1, 10, 100], "learning_rate": [0.001, 0.01, 0.1, 0.3, 0.5, 0.7, 0.9],
       "max_depth": [3, 5, 10, 50, 100, 150, 200], "min_child_weight": [1, 3, 5, 10], "subsample": [0.8, 0.9, 1.0]}

GRIDS: dict[str, dict[str, list]] = {
    "adaboost": {"n_estimators": N},
    "easy_ensemble": {"n_estimators": N},
    "rusboost": {"n_estimators": N[1:], "learning_rate": [0.001, 0.01, 0.1, 0.5, 1, 3, 5, 10, 15, 20], "sampling_strategy": STRATEGIES},
    "random_forest": {"n_estimators": N, "max_depth": LONG_N, "max_features": FEATURES, "criterion": CRITERIA},
    "balanced_random_forest": {"n_estimators": N, "criterion": CRITERIA, "max_features": FEATURES, "sampling_strategy": STRATEGIES},
    "balanced_bagging": {"n_estimators": N, "sampling_strategy": STRATEGIES, "max_features": [5, 10, 15, 20]},
    "weighted_random_forest": {"n_estimators": N, "max_depth": [6, 50, 100, 150, 200], "max_features": FEATURES, "criterion": CRITERIA, "class_weight": CLASS_WEIGHTS},
    "weighted_svc": {**SVC_RANGE, "class_weight": CLASS_WEIGHTS},
    "svc": SVC_RANGE,
    "boosted_trees": XGB,
    "isolation_forest": {"n_estimators": N, "contamination": [0.1, 0.2, 0.3, 0.4, 0.5], "max_samples": [256, 512, 1024, 2048, "auto"]},
    "imbalanced_ensemble_balanced_cascade": {"n_estimators": N, "criterion": CRITERIA},
    "imbalanced_ensemble_self_paced": {"n_estimators": N, "criterion": CRITERIA},
    "imbalanced_ensemble_balanced_random_forest": {"n_estimators": [10, *LONG_N], "criterion": CRITERIA, "max_features": FEATURES},
    "imbalanced_ensemble_easy_ensemble": {"n_estimators": N, "max_features": MORE_FEATURES},
    "imbalanced_ensemble_underbagging": {"n_estimators": N, "max_features": MORE_FEATURES},
    "imbalanced_ensemble_overboost": {"n_estimators": N, "learning_rate": RATES, "algorithm": ALGORITHMS},
    "imbalanced_ensemble_adacost": {"n_estimators": N, "learning_rate": RATES, "algorithm": ALGORITHMS},
    "imbalanced_ensemble_adauboost": {"n_estimators": N, "learning_rate": RATES, "algorithm": ALGORITHMS},
    "imbalanced_ensemble_smote_boost": {"n_estimators": N, "learning_rate": RATES, "k_neighbors": SYNTH_NEAR, "algorithm": ALGORITHMS},
    "imbalanced_ensemble_smote_bagging": {"n_estimators": N, "max_features": [5, 10, 15, 20], "k_neighbors": SYNTH_NEAR},
    "imbalanced_ensemble_kmeans_smote_boost": {"n_estimators": N, "learning_rate": RATES, "k_neighbors": SYNTH_NEAR, "algorithm": ALGORITHMS,
                                               "cluster_balance_threshold": ["auto", 0.1, 0.01, 0.001, 0.0001, 0.00005, 0.00001]},
    "pyod_pca": {},
    "pyod_copod": {},
    "pyod_xgbod": {},
    "pyod_feature_bagging": {"n_estimators": N, "max_features": [0.5, 0.7, 1.0], "combination": ["average", "max"]},
    "pyod_isolation_forest": {"n_estimators": N, "max_samples": [0.5, 0.7, 1.0, "auto"], "max_features": [0.5, 0.7, 1.0]},
    "pyod_loda": {"cuts": [10, *LONG_N]},
    "pyod_hbos": {"alpha": ODD_TENTHS, "tol": ODD_TENTHS},
    "pyod_sod": {"alpha": ODD_TENTHS, "k": [10, 15, 20, 25, 30]},
    "pyod_cblof": {"n_clusters": [2, 3, 5, 8, 10, 15], "alpha": [0.6, 0.7, 0.8, 0.9], "beta": [2, 5, 10, 15, 20, 50, 100], "use_weights": [True, False]},
    "pyod_cof": {"k": NEAR},
    "pyod_lof": {"k": NEAR},
    "pyod_knn": {"k": NEAR[:4], "method": ["largest", "mean", "median"]},
    "pyod_lmdd": {"n_iter": [20, 50, 100, 150, 200]},
    "pyod_loci": {"alpha": [0.5, 1.0, 2.0, 2.5, 5.0]},
    "pyod_mcd": {"assume_centered": [True, False]},
    "pyod_sos": {"perplexity": [0.001, 0.01, 0.1, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 7.0, 10.0], "eps": [0.001, 0.01, 0.1, 0.5, 1.0]},
}
