"""Fixed values that right results need; queries and their SQL both take them from here."""

#: Fixed values of the parameter sweep.
SWEEP = (0.01, 0.05, 0.07, 0.09, 0.1, 0.5, 1, 3, 5, 7, 9, 10, 15, 20, 25, 30, 35, 40, 45, 50)
#: Windows that the registered queries compare, fine to coarse.
WINDOWS = (5, 20, 40)
#: Fixed values of the cutters: least frequency jump of the tree cut's queries, longest block before a jump cut is refined.
TREE_JUMP = 3
MAX_BLOCK = 400
#: Fixed values of the surveyed programs: jump of the tree cut, windows compared by cost, most tokens of a collection and of a version.
FIXED_JUMP = 10
COST_WINDOWS = (20, 30, 40)
MAX_TOKENS = 1_000_000
MAX_VERSION = 20_000
