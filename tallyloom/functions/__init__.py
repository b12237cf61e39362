"""Part of the learner-activity engine."""
