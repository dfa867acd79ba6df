"""Detectors of faults in pictures: measures of single frames, put together by Spark into a score of each source.

A table of frames has source, frame (numbers from 0), height, width and planes (operators.planes). Every detector gives
(source, score, summary, worst_s): a score of 0 is clean, a negative one means that the detector doesn't apply.
"""
