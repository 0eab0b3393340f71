"""The row-wise operators on streams.

Cleaning, tagging, weak labels and attacks keep no state, so they take a
streaming table as they take a static one. Only the plumbing lives here.
"""
