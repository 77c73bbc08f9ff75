"""Fixed values of the two study configurations.

Feature lists, skew lists, frozen rule tables, model terms and starting terms. These are data, not
logic: every operator takes them as arguments and works with any other configuration.
"""

from __future__ import annotations

# --- fixed values: form types that are not measurements -----------------------------------------
INTERVAL_FORMS = ("Adverse Event", "Concomitant Medication")
MISSING_MARK = "-"
WINDOW_DAYS = 92
TOTAL_SCORE = "ALSFRS_Total"
SCORE_AT_ONSET = 39.0
HORIZON_DAYS = (12 * 30.5, 18 * 30.5, 24 * 30.5)
KNN_K, KNN_MAX_BLOCK, KNN_ROW_LIMIT, KNN_COL_LIMIT = 10, 1500, 0.8, 0.8
HOLDOUT_SHARE = 0.333334
ABUNDANCE_LIMIT = 0.77
TOP_MODELS = 20
SELECTION_REPS = 5000

# --- fixed values: feature whitelists (less than 25 percent missing) -----------------------------
TRIAL_FEATURES = (
    "Lymphocytes", "Basophils", "Monocytes", "Total Cholesterol", "Gamma-glutamyltransferase",
    "CK", "height", "Red Blood Cells (RBC)", "White Blood Cell (WBC)", "Urine Ph", "Bicarbonate",
    "if_use_Riluzole", "Q10_Respiratory", "respiratory_rate", "Calcium", "Phosphorus",
    "Platelets", "Alkaline Phosphatase", "bp_diastolic", "bp_systolic", "pulse",
    "treatment_group", "Hematocrit", "Hemoglobin", "Chloride", "fvc", "fvc_normal",
    "fvc_percent", "Potassium", "Q5a_Cutting_without_Gastrostomy", "Sodium", "AST(SGOT)",
    "Blood Urea Nitrogen (BUN)", "Creatinine", "ALT(SGPT)", "Bilirubin (Total)", "onset_delta",
    "Age", "ALSFRS_Total", "Gender", "hands", "leg", "mouth", "onset_site", "Q1_Speech",
    "Q2_Salivation", "Q3_Swallowing", "Q4_Handwriting", "Q5_Cutting", "Q6_Dressing_and_Hygiene",
    "Q7_Turning_in_Bed", "Q8_Walking", "Q9_Climbing_Stairs", "Race", "respiratory", "trunk",
    "weight",
)
REGISTRY_FEATURES = (
    "Age", "ALS_Staging_Breath", "ALS_Staging_Com", "ALS_Staging_Eat", "ALS_Staging_Move",
    "ALS_Staging_Total", "ALSFRS_R_Total", "ALSFRS_Total", "family_ALS_hist", "Gender", "hands",
    "leg", "MEDHx_Diabetes", "MEDHx_Hypertens", "MEDHx_Thyroid", "mouth", "Mutation",
    "onset_delta", "onset_site", "Q1_Speech", "Q2_Salivation", "Q3_Swallowing",
    "Q4_Handwriting", "Q5_Cutting", "Q6_Dressing_and_Hygiene", "Q7_Turning_in_Bed", "Q8_Walking",
    "Q9_Climbing_Stairs", "R1_Dyspnea", "R2_Orthopnea", "R3_Respiratory_Insufficiency",
    "respiratory", "respiratory_R", "trunk",
)
TRIAL_CATEGORICAL = ("Race", "onset_site", "Gender", "treatment_group", "if_use_Riluzole")
REGISTRY_CATEGORICAL = (
    "MEDHx_Thyroid", "Gender", "MEDHx_Diabetes", "MEDHx_Hypertens", "family_ALS_hist",
    "onset_site", "Mutation",
)
RIGHT_SKEWED = (
    "Gamma-glutamyltransferase", "CK", "Red Blood Cells (RBC)", "Urine Ph", "AST(SGOT)",
    "ALT(SGPT)", "Bilirubin (Total)",
)
LEFT_SKEWED = ("onset_delta", "hands", "leg", "mouth", "respiratory", "trunk", "ALSFRS_Total")

# --- fixed values: frozen stratum rules, checked top-down -----------------------------------------
# (label, ((column, operator, threshold), ...)); operands are the standardised columns
RULES_TRIAL_SLOPE = (
    (111, (("onset_delta", ">=", 0.053412932), ("Q1_Speech", "<", 0.66757882), ("hands", "<", 2.01044607))),
    (112, (("onset_delta", ">=", 0.053412932), ("Q1_Speech", "<", 0.66757882), ("hands", ">=", 2.01044607))),
    (12, (("onset_delta", ">=", 0.04964584), ("onset_delta", "<", 0.053412932), ("Q1_Speech", "<", 0.66757882))),
    (21, (("onset_delta", ">=", 0.04964584), ("Q1_Speech", ">=", 0.66757882), ("trunk", "<", 0.58163565))),
    (22, (("onset_delta", ">=", 0.04964584), ("Q1_Speech", ">=", 0.66757882), ("trunk", ">=", 0.58163565))),
    (3, (("onset_delta", ">=", -0.03113981), ("onset_delta", "<", 0.04964584))),
    (4, (("onset_delta", "<", -0.03113981),)),
)
RULES_TRIAL_SURVIVAL = (
    (4, (("fvc_percent", "<", -0.464656830),)),
    (1, (("fvc_percent", ">=", -0.464656830), ("onsetAge", "<", -0.007705498))),
    (2, (("fvc_percent", ">=", -0.464656830), ("onsetAge", ">=", -0.007705498), ("ALSFRS_Total", ">=", 0.077406712))),
    (3, (("fvc_percent", ">=", -0.464656830), ("onsetAge", ">=", -0.007705498), ("ALSFRS_Total", "<", 0.077406712))),
)
RULES_REGISTRY_SLOPE = (
    (3, (("onset_delta", "<", 0.1464),)),
    (1, (("onset_delta", ">=", 0.1464), ("priorSlope", "<", 0.4279))),
    (2, (("onset_delta", ">=", 0.1464), ("priorSlope", ">=", 0.4279))),
)
RULES_REGISTRY_SURVIVAL = (
    (3, (("priorSlope", "<", -0.001987586),)),
    (1, (("priorSlope", ">=", -0.001987586), ("onset_delta", "<", 0.132676146))),
    (2, (("priorSlope", ">=", -0.001987586), ("onset_delta", ">=", 0.132676146))),
)

# --- fixed values: model terms per stratum ("a*b" = a + b + a:b, "a:b" = product only) ------------
MODELS_TRIAL_SLOPE = {
    111: ("Q9_Climbing_Stairs", "treatment_group", "Phosphorus"),
    112: ("Gender", "Creatinine", "Alkaline Phosphatase", "White Blood Cell (WBC)",
          "Creatinine*White Blood Cell (WBC)", "Potassium", "White Blood Cell (WBC)*Potassium"),
    12: ("ALSFRS_Total", "CK", "ALSFRS_Total*CK", "fvc_normal"),
    21: ("onset_delta", "bp_systolic", "Q10_Respiratory", "Alkaline Phosphatase"),
    22: ("onset_delta", "Q5_Cutting", "fvc_percent"),
    3: ("mouth", "trunk", "fvc", "mouth*trunk"),
    4: ("trunk", "Race", "bp_diastolic", "if_use_Riluzole"),
}
MODELS_REGISTRY_SLOPE = {
    1: ("ALS_Staging_Com", "ALSFRS_Total", "Q1_Speech", "Q9_Climbing_Stairs", "hands"),
    2: ("Q1_Speech", "Gender", "Q4_Handwriting", "MEDHx_Diabetes", "ALS_Staging_Total", "ALS_Staging_Move"),
    3: ("onset_site", "ALS_Staging_Eat", "priorSlope", "Q6_Dressing_and_Hygiene", "trunk", "Gender"),
}
MODELS_TRIAL_SURVIVAL = {
    1: ("fvc", "priorSlope", "onsetAge", "fvc_normal", "Chloride"),
    2: ("trunk", "priorSlope", "onsetAge", "fvc_percent"),
    3: ("fvc", "priorSlope", "onsetAge", "fvc_percent", "Gender"),
    4: ("fvc", "priorSlope", "onsetAge", "Hemoglobin", "Chloride"),
}
MODELS_REGISTRY_SURVIVAL = {
    1: ("priorSlope", "onsetAge", "ALS_Staging_Total", "priorSlope*ALS_Staging_Total", "Age", "respiratory"),
    2: ("priorSlope", "onsetAge", "Q1_Speech", "Gender"),
    3: ("priorSlope", "onsetAge", "hands", "MEDHx_Thyroid"),
}

# --- fixed values: starting terms of the stepwise search ------------------------------------------
START_TRIAL_SLOPE = {
    111: ("Q9_Climbing_Stairs", "treatment_group", "Phosphorus"),
    112: ("Gender", "Creatinine", "Alkaline Phosphatase", "White Blood Cell (WBC)",
          "Creatinine:White Blood Cell (WBC)"),
    12: ("ALSFRS_Total", "CK", "ALSFRS_Total*CK", "fvc_normal"),
    21: ("onset_delta", "bp_systolic", "Q10_Respiratory", "Alkaline Phosphatase"),
    22: ("onset_delta", "Q5_Cutting", "fvc_percent"),
    3: ("mouth", "trunk", "fvc", "mouth:trunk"),
    4: ("trunk", "Race", "bp_diastolic", "if_use_Riluzole"),
}
START_REGISTRY_SLOPE = MODELS_REGISTRY_SLOPE
START_TRIAL_SURVIVAL = {
    1: ("fvc", "priorSlope", "onsetAge"),
    2: ("trunk", "priorSlope", "onsetAge"),
    3: ("fvc", "priorSlope", "onsetAge"),
    4: ("fvc", "priorSlope", "onsetAge"),
}
START_REGISTRY_SURVIVAL = {
    1: ("priorSlope", "onsetAge", "ALS_Staging_Total", "priorSlope*ALS_Staging_Total"),
    2: ("priorSlope", "onsetAge", "Q1_Speech"),
    3: ("priorSlope", "onsetAge", "hands"),
}

# --- fixed values: tree growth ---------------------------------------------------------------------
TREE_CP = 0.005
TREE_MINSPLIT = {"trial_slope": 250, "registry_slope": 25, "trial_survival": 3000, "registry_survival": 400}

# --- fixed values: which raw features a derived feature is computed from ---------------------------
DERIVED_FROM = {
    "priorSlope": ("onset_delta", "ALSFRS_Total"),
    "onsetAge": ("onset_delta", "Age"),
}
