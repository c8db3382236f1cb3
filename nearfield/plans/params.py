"""Parameters of the registered queries, shared with the checking SQL."""

R = 8  # neighbours per vertex in the graph
L, K = 20, 10  # list length, results per query
W, T = 4, 5  # wide phase: vertices per step, first wide step
WIDE_L = 40  # list length of the approximate and widened searches
POST_L, POST_W = 200, 20  # list length and wide step of the post-filter search
CELL_ROWS = 32  # rows per cell
VALUES = 24  # attribute values
DIM, M, KSUB = 64, 8, 16  # vector dimension, subspaces, codes per subspace
PQ_L, PQ_K, PQ_W, PQ_T = 60, 30, 16, 5
