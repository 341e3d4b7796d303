"""tabprobe.operators"""
