"""Names of the per-window breathing metrics (fixed values of the data model)."""

#: The 35 metrics, in lower case, in their natural order.
METRICS = (
    "inhale_volume", "exhale_volume", "inhale_duration", "exhale_duration", "inhale_value", "exhale_value",
    "inter_breath_interval", "rate", "tidal_volume", "minute_ventilation", "duty_cycle_inhale", "duty_cycle_exhale",
    "cov_inhaledutycycle", "cov_exhaledutycycle", "cov_breathingrate", "cov_inhalevolume", "cov_exhalevolume",
    "post_inhale_pause_mean", "post_inhale_pause_std", "post_exhale_pause_mean", "post_exhale_pause_std",
    "pause_dutycycle_inhale", "pause_dutycycle_exhale", "multiphasic_count", "multiphasic_ratio",
    "multiphasic_inhale_count", "multiphasic_exhale_count", "multiphasic_inhale_ratio", "multiphasic_exhale_ratio",
    "peaksperbreath_mean", "peaksperbreath_max", "interpeakinterval_mean", "interpeakinterval_std",
    "secondarypeakratio_mean", "secondarypeakratio_std",
)

#: Those that count something.
COUNTS = ("multiphasic_count", "multiphasic_inhale_count", "multiphasic_exhale_count", "peaksperbreath_max")

#: Valid categories of a window.
POSTURES = ("supine", "prone", "left", "right", "sitting")
SENSORS = ("belt", "cannula", "mask")
