"""Parameters of the catalogue's queries, shared with their SQL."""

#: The benchmark table has no name column; its rules are those of question-and-answer records.
BENCHMARK = "niilc"
#: Seed and number of draws of the schedule, tokens in a chunk and in a step.
SEED, CHUNKS, CHUNK, STEP = 11, 400, 2048, 5120
#: Tokens in a packed row.
LENGTH = 64
MTP_WEIGHTS = [0.5, 0.25, 0.125]
#: Valid tokens at which validation stops, steps in which every major source has to appear, records that are kept.
VALID, COVERAGE_STEPS, RECENT = 2_000_000, 100, 100
