"""DataFrame operators: calibration, audit, groups, splits and paired conditions."""
