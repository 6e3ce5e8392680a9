"""Voxelith: labelled voxel grids and region graphs as Spark DataFrames."""
