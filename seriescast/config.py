"""Fixed values that results depend on, stated once.

Fixed values (they must equal the reference's for equal results):

* measured parameters, in the reference's order:
  ALLSKY_SFC_SW_DWN, ALLSKY_SFC_SW_DNI, ALLSKY_SFC_SW_DIFF, CLRSKY_SFC_SW_DWN,
  T2M, RH2M, WS2M, PRECTOTCORR, PS, ALLSKY_KT
* missing-value sentinel: -999
* division guard epsilon: 1e-10
* tolerance band of the variance ratio: [-0.10, +0.10], closed
* percent-variance range labels and edges, in order:
  '<-10%' (x < -10), '<-5%' (-10 <= x < -5), '-5% to 0%' (-5 <= x < 0),
  '0% to +5%' (0 <= x <= 5), '>5% to 10%' (5 < x <= 10), '>10%' (x > 10)
* site latitude used by the day-length feature: 29.92 degrees
* random seed: 42
"""

PARAMS = [
    "ALLSKY_SFC_SW_DWN", "ALLSKY_SFC_SW_DNI", "ALLSKY_SFC_SW_DIFF",
    "CLRSKY_SFC_SW_DWN", "T2M", "RH2M", "WS2M", "PRECTOTCORR", "PS", "ALLSKY_KT",
]
SENTINEL = -999.0
EPS = 1e-10
TIGHT_LO, TIGHT_HI = -0.10, 0.10
RANGE_LABELS = ["<-10%", "<-5%", "-5% to 0%", "0% to +5%", ">5% to 10%", ">10%"]
LATITUDE = 29.92
SEED = 42

# Names of the date-part columns of a raw daily file.
DATE_PARTS = ["YEAR", "MO", "DY"]
