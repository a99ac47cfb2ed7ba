"""Query plans: named compositions of operators, each with its oracle SQL."""
