"""Column names every panel job shares."""

from __future__ import annotations

# The key, label and look-ahead column names of the bank panel.
ENTITY = "numero_de_cliente"
PERIOD = "foto_mes"
LABEL = "clase_ternaria"
LAST_PERIOD = "mes_ultimo"
N_PERIODS = "meses_historia"
HAS_LEFT = "es_baja"
EXIT_PERIOD = "mes_baja"
PERIODS_LEFT = "k"

# The three labels.
STAYS = "CONTINUA"
LEAVES_NEXT = "BAJA+1"
LEAVES_IN_TWO = "BAJA+2"

#: Columns that look at the future; never predictors.
LOOK_AHEAD = (LAST_PERIOD, EXIT_PERIOD, HAS_LEFT, PERIODS_LEFT, N_PERIODS)
#: Keys, labels and weights, and the two columns broken in the target month.
NOT_PREDICTORS = (ENTITY, PERIOD, LABEL, "clase_binaria", "peso", "Visa_Finiciomora", "Master_Finiciomora")

# Gain of a hit, cost of a miss, bounds of a selection, seeds.
GAIN_HIT = 1_072_500
COST_MISS = 27_500
BREAK_EVEN = COST_MISS / (GAIN_HIT + COST_MISS)
MIN_SELECTED, MAX_SELECTED = 8_000, 15_000
SEEDS = (261431, 269281, 429899, 560771, 749401)
